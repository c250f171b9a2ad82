"""Queries over what comes in again and again: call logs, versions of lists, raw reports, sketches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, sketches, versions
from ..sources import reports
from ..sources.tables import scratch, streamed, table
from ..streaming import sessions

_START = "timestamp_ntz'2024-01-01 00:00:00'"


def _calls(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Calls drawn from events and, one each, from documents: id, ts, session_id, api, violation."""
    one = events.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_type").alias("api"), (F.col("event_id") % 11 == 0).alias("violation"), F.col("user_id").alias("caller"), F.col("value").alias("value"), F.floor(F.col("event_id") / 500).alias("team"))
    at = F.expr(f"{_START} + make_dt_interval(0, 0, 0, (doc_id * 7919) % 2592000)")
    two = documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), at.alias("ts"), F.concat(F.lit("s"), (F.col("doc_id") % 40).cast("string")).alias("session_id"), F.col("lang").alias("api"), (F.col("doc_id") % 7 == 0).alias("violation"), (F.col("doc_id") * 31 % 5003).alias("caller"), F.col("n_chars").cast("double").alias("value"), F.floor(F.col("doc_id") / 500).alias("team"))
    return one.unionByName(two)


def session_logs(spark, sf_dir):
    """The session logs of a stream of all calls, run to its end."""
    calls = _calls(streamed(spark, sf_dir, "events"), streamed(spark, sf_dir, "documents"))
    rows = sessions.run_to_end(sessions.session_logs(calls), scratch(spark, "session-logs"), spark.sparkContext.defaultParallelism)
    return sessions.last_logs(rows).withColumn("first_ts", F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def counts_at_calls(spark, sf_dir):
    """For each call, how many calls of its API there were within a minute, an hour and a day up to it."""
    calls = _calls(table(spark, sf_dir, "events"), table(spark, sf_dir, "documents")).select("id", "api", "ts")
    return asof.counts_before(calls, keys=["api"], time="ts", seconds=(60, 3600, 86400)).select("id", "api", "last_60", "last_3600", "last_86400")


def _versions(spark, sf_dir) -> list[DataFrame]:
    """Three versions of a list: some rows are missing, come, go and change."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    i = F.col("doc_id")
    second = docs.where(i % 11 != 0).withColumn("n_chars", F.when(i % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    third = docs.where(i % 13 != 0).withColumn("lang", F.when(i % 5 == 0, None).otherwise(F.col("lang")))
    return [docs.where(i % 10 != 3), second, third]


def _history(spark, sf_dir) -> DataFrame:
    one, *later = _versions(spark, sf_dir)
    history = versions.first_version(one, ["doc_id"], 1)
    for version, snapshot in enumerate(later, 2):
        history = versions.with_version(history, snapshot, ["doc_id"], version)
    return history


def list_history(spark, sf_dir):
    """The history of a list that was reloaded twice."""
    return _history(spark, sf_dir)


def list_changes(spark, sf_dir):
    """What a reload changed."""
    one, two, _ = _versions(spark, sf_dir)
    out = versions.changes(one, two, ["doc_id"])
    return out.select("doc_id", "change", F.col("old.n_chars").alias("old_n_chars"), F.col("new.n_chars").alias("new_n_chars"))


def old_lookups(spark, sf_dir):
    """Labels looked up in the list as it was at its second version."""
    held = versions.at_version(_history(spark, sf_dir), 2)
    return table(spark, sf_dir, "labels").select("doc_id", "quality").join(held, "doc_id", "left").select("doc_id", "quality", "source", "n_chars")


def _broken(text, k):
    """One report in twenty is cut short, and some are no objects."""
    return F.when(k % 20 == 7, F.substring(text, F.lit(1), F.length(text) - 3)).when(k % 20 == 13, F.lit("[1, 2]")).when(k % 101 == 5, None).otherwise(text)


def _verdicts(spark, sf_dir) -> DataFrame:
    """Reports of one provider on orders and documents as it would send them."""
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("ioc"), F.col("o_orderkey").alias("k"), F.lower("o_orderpriority").alias("tag"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("ioc"), F.col("doc_id").alias("k"), F.lower("lang").alias("tag"))
    k = F.col("k")
    stats = F.struct((k % 61).alias("malicious"), F.when(k % 3 != 0, k % 5).alias("suspicious"), F.when(k % 4 == 0, F.lit("many")).otherwise((k % 70).cast("string")).alias("harmless"))
    attributes = F.struct(F.when(k % 9 != 0, stats).alias("last_analysis_stats"), F.when(k % 2 == 0, k + 1_700_000_000).alias("last_modification_date"), (k + 1_600_000_000).alias("last_analysis_date"), F.when(k % 6 != 0, F.array("tag", F.lit("seen"))).alias("tags"))
    text = F.to_json(F.struct(F.struct(attributes.alias("attributes")).alias("data")))
    return orders.unionByName(docs).select("ioc", _broken(text, k).alias("json"))


def provider_reports(spark, sf_dir):
    """Fields of raw verdict reports, one in ten of them broken."""
    rows = reports.with_report(_verdicts(spark, sf_dir), "json")
    out = rows.select("ioc", "broken", reports.fields(F.col("report"), reports.VERDICT).alias("f"))
    return out.select("ioc", "broken", "f.malicious", "f.suspicious", "f.harmless", "f.undetected", "f.last_seen", F.array_join("f.tags", "|").alias("tags"))


def pulse_reports(spark, sf_dir):
    """Counts, families and tags of raw pulse reports on documents, listed at the top or below general."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    i = F.col("doc_id")
    family = F.when(i % 3 == 0, F.to_json(F.struct(F.upper("lang").alias("display_name")))).when(i % 3 == 1, F.to_json(F.struct(F.lit("").alias("display_name"), F.upper("lang").alias("name")))).otherwise(F.concat(F.lit('"'), F.upper("lang"), F.lit('"')))
    pulse = F.concat(F.lit('{"tags": [" Botnet", "'), F.col("source"), F.lit('", 5, ""], "malware_families": ['), family, F.lit(', "Hive"]}'))
    info = F.concat(F.lit('{"count": '), (i % 4).cast("string"), F.lit(', "pulses": ['), F.array_join(F.array_repeat(pulse, (i % 3).cast("int")), ", "), F.lit("]}"))
    text = F.when(i % 2 == 0, F.concat(F.lit('{"pulse_info": '), info, F.lit("}"))).otherwise(F.concat(F.lit('{"pulse_info": null, "general": {"pulse_info": '), info, F.lit("}}")))
    rows = reports.with_report(docs.select("doc_id", _broken(text, i).alias("json")), "json")
    out = rows.select("doc_id", "broken", reports.pulses(F.col("report")).alias("p"))
    return out.select("doc_id", "broken", "p.pulse_count", F.array_join("p.families", "|").alias("families"), F.array_join("p.tags", "|").alias("tags"))


def merged_sketches(spark, sf_dir):
    """Callers and values of each API and team over three spans of days, from sketches by day; each estimate held against the exact figures of its span."""
    calls = _calls(table(spark, sf_dir, "events"), table(spark, sf_dir, "documents")).select("api", "team", "ts", "caller", "value")
    days = sketches.by_day(calls, ["api", "team"], "ts", "caller", "value")
    spans = {"whole": (None, None), "second_week": ("2024-01-08", "2024-01-14"), "one_day": ("2024-01-20", "2024-01-20")}
    out = None
    for name, (first, last) in spans.items():
        day = lambda d: None if d is None else F.lit(d).cast("date")
        told = sketches.estimates(sketches.over_span(days, ["api", "team"], day(first), day(last)), ["api", "team"], (0.5, 0.95))
        at = F.to_date("ts")
        inside = calls.where(F.lit(True) if first is None else at.between(day(first), day(last)))
        # of an estimated quantile, the share of values below it and up to it must hold the quantile, but for the error of its rank
        met = inside.join(told, ["api", "team"])
        rank = lambda q: [F.count_if(F.col("value") < F.col(q)) / F.count("value"), F.count_if(F.col("value") <= F.col(q)) / F.count("value")]
        ok = lambda q, share: (rank(q)[0] <= share + sketches.RANK_ERROR) & (rank(q)[1] >= share - sketches.RANK_ERROR)
        off = F.abs(F.any_value("n_distinct") / F.countDistinct("caller") - 1)
        held = met.groupBy("api", "team").agg(F.any_value("n").alias("n"), F.countDistinct("caller").alias("callers"), (off <= 4 * sketches.DISTINCT_ERROR).alias("callers_ok"), ok("q_50", 0.5).alias("median_ok"), ok("q_95", 0.95).alias("high_ok"))
        held = held.withColumn("span", F.lit(name))
        out = held if out is None else out.unionByName(held)
    return out.select("span", "api", "team", "n", "callers", "callers_ok", "median_ok", "high_ok")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (session_logs, counts_at_calls, list_history, list_changes, old_lookups, provider_reports, pulse_reports, merged_sketches)}
