"""Queries of the joins that look things up in tables of any size: suffix rules, near names, patterns, known states, address ranges, chains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DOMAIN, IPV4, matches
from ..operators.asof import as_of
from ..operators.neighbours import nearest_name
from ..operators.patterns import first_pattern
from ..operators.ranges import covering, prefixes_of
from ..operators.redirects import followed_chains
from ..operators.suffixes import with_suffix_split
from ..sources.tables import table

#: Input tables of the queries, drawn from given ones: plain SQL, for both engines.
SUFFIX_RULES = """
select distinct regexp_extract(host, '[^.]*$', 0) as rule from hosts
union select distinct regexp_extract(host, '[^.]*[.][^.]*$', 0) as rule from hosts where page_id % 4 = 0 and host like '%.org'
union select '*.' || regexp_replace(host, '^[^.]*[.]', '') as rule from hosts where page_id % 3 = 0 and host like '%.%.%.%'
union select '!' || host as rule from hosts where page_id % 2 = 0 and host like '%.%.%.%'
"""
PATTERNS = """
select translate(lpad(cast(c_custkey % 10000 as varchar(9)), 4, '0'), '0123456789', 'theanriosl') as pattern, (c_custkey * 7919) % 10007 as priority, c_mktsegment as label from customer
"""
NETWORKS = """
select c_custkey as id, cast(c_custkey % 224 as varchar(9)) || '.' || cast((c_custkey * 13) % 256 as varchar(9)) || '.0.0/' || cast(4 + c_custkey % 9 as varchar(9)) as cidr from customer
"""
HOPS = """
select a.url as url, b.url as target, o.o_orderkey as ord
from orders o join pages a on a.page_id = o.o_custkey % 1009 join pages b on b.page_id = (o.o_orderkey * 7) % 997 where o.o_orderkey % 5 <> 0
"""


def _drawn(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """The rows of one of the statements above over the given tables."""
    for name, df in tables.items():
        sql = sql.replace(f" {name} ", f" {{{name}}} ").replace(f" {name}\n", f" {{{name}}}\n")
    return spark.sql(sql, **tables)


def suffix_splits(spark, sf_dir):
    """The hosts of the pages' urls and those in documents, split by a table of suffix rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    named = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(matches(F.col("text"), DOMAIN, r"[a-zA-Z0-9]\.[a-zA-Z]{2}"))).alias("host"))
    rows = pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("key"), "host").unionByName(named.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), "host"))
    out = with_suffix_split(rows, _drawn(spark, SUFFIX_RULES, hosts=pages))
    return out.select("key", "host", "split.registrable_domain", F.array_join("split.subdomain_labels", "|").alias("subdomain_labels"), "split.domain", "split.suffix")


def _words(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(F.regexp_extract_all(F.lower(F.col(column)), F.lit("[a-z]+"), F.lit(0))).alias("word"))


def nearest_names(spark, sf_dir):
    """Words of documents with the nearest of the words in the parts' names and types and in the benchmark."""
    parts = table(spark, sf_dir, "part")
    names = _words(parts, "p_name").union(_words(parts, "p_type")).union(_words(table(spark, sf_dir, "benchmark"), "text"))
    return nearest_name(_words(table(spark, sf_dir, "documents"), "text"), names.withColumnRenamed("word", "name"))


def first_patterns(spark, sf_dir):
    """Each document with the first by priority of the customers' patterns that it holds."""
    patterns = _drawn(spark, PATTERNS, customer=table(spark, sf_dir, "customer"))
    return first_pattern(table(spark, sf_dir, "documents"), patterns, id_col="doc_id", text_col="text")


def known_states(spark, sf_dir):
    """Each event with the document that its user had last by then; one user has a third of both."""
    user = lambda row, own: F.when(F.col(row) % 3 == 0, 1).otherwise(own).cast("long").alias("user_id")
    events = table(spark, sf_dir, "events").select("event_id", user("event_id", F.col("user_id")), "ts")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, (doc_id * 7919) % 2592000)")
    docs = table(spark, sf_dir, "documents").select(user("doc_id", F.col("doc_id") % 1000), at.alias("at"), "lang", "n_chars")
    out = as_of(events, docs, keys=["user_id"], event_time="ts", record_time="at", columns=["n_chars", "lang"])
    return out.select("event_id", "user_id", "known.n_chars", "known.lang", F.date_format("known.at", "yyyy-MM-dd HH:mm:ss").alias("known_at"))


def address_ranges(spark, sf_dir):
    """The addresses in documents with the narrowest of the customers' networks."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(matches(F.col("text"), rf"\b{IPV4}\b", r"\d\.\d{1,3}\.\d"))).alias("address"))
    networks = _drawn(spark, NETWORKS, customer=table(spark, sf_dir, "customer"))
    return covering(found, prefixes_of(networks, "id", cidr_col="cidr"))


def followed_pages(spark, sf_dir):
    """The chains of the pages' urls over hops that orders draw between them."""
    hops = _drawn(spark, HOPS, pages=table(spark, sf_dir, "pages"), orders=table(spark, sf_dir, "orders"))
    out = followed_chains(hops)
    return out.select("url", F.array_join("chain", " ").alias("chain"), "final_url", "n_hops", "cyclic", "capped")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (suffix_splits, nearest_names, first_patterns, known_states, address_ranges, followed_pages)}
