"""Public-suffix split of hosts by a table of rules.

Rules are written as in the public-suffix list: ``co.uk``, ``*.ck`` (any one label below
ck), ``!www.ck`` (though not that one). A host's labels from each of its dots on are looked
up in the rules by equality; an exception counts before all, then the rule of most labels, and
where no rule holds, the last label is the suffix.

Scale: each distinct host is looked up once; its suffixes meet the rules in one equi-join, which
Spark broadcasts only where the rule table is small by its own statistics. Hosts are joined
back by equality, where adaptive execution splits a host that very many rows have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hosts import host_suffixes, looks_like_ip, normal_host, without_www
from ..functions.text import let, strings
from ..sources.tables import settled


def rule_file(spark: SparkSession, path: str, rule_col: str = "rule") -> DataFrame:
    """The rules of a Parquet table."""
    return spark.read.parquet(path).select(F.col(rule_col).alias("rule"))


def parsed_rules(rules: DataFrame, rule_col: str = "rule") -> DataFrame:
    """(base, exception, labels): what a host must end with, and how many labels the suffix then has; each once.

    Comments, blank and null rules are passed over; case, a leading or a last dot don't matter.
    """
    raw = F.regexp_replace(F.lower(F.trim(F.col(rule_col))), r"^\.|\.$", "")
    rows = rules.select(raw.alias("r")).where((F.col("r") != "") & ~F.startswith("r", F.lit("//")))
    exception, wild = F.startswith("r", F.lit("!")), F.startswith("r", F.lit("*."))
    rows = rows.select(F.regexp_replace("r", r"^(?:!|\*\.)", "").alias("base"), exception.alias("exception"), F.when(exception, -1).when(wild, 1).otherwise(0).alias("more"))
    return rows.select("base", "exception", (F.size(F.split("base", r"\.")) + F.col("more")).alias("labels")).distinct()


def _split(host: Column, k: Column) -> Column:
    """Hostname, registrable_domain, subdomain_labels, domain and suffix of a host whose last ``k`` labels are its suffix; 0 for none."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    suffix = F.array_join(F.slice(parts, n - k + 1, k), ".")
    domain = F.when(k == 0, host).otherwise(F.coalesce(F.get(parts, n - k - 1), F.lit("")))
    registrable = F.when((k > 0) & (domain != ""), F.concat(domain, F.lit("."), suffix)).otherwise(host)
    below = F.when((k > 0) & (n > k + 1), F.filter(F.slice(parts, F.lit(1), n - k - 1), lambda x: x != "")).otherwise(strings([]))
    return F.struct(host.alias("hostname"), registrable.alias("registrable_domain"), below.alias("subdomain_labels"), domain.alias("domain"), F.when(k == 0, "").otherwise(suffix).alias("suffix"))


def with_suffix_split(rows: DataFrame, rules: DataFrame, host_col: str = "host", rule_col: str = "rule", into: str = "split") -> DataFrame:
    """``rows`` with the struct ``into`` of hostname, registrable_domain, subdomain_labels, domain and suffix.

    Hosts are lower-cased, without scheme, path, port and www. first. Addresses and
    hosts of a single label have no suffix; a host that is itself a suffix has no domain, and
    is its own registrable domain. A null host counts as empty. Rows, repeated ones too, all stay.
    """
    host = without_www(normal_host(F.col(host_col)))
    keyed = rows.withColumn("_host", host)
    hosts = keyed.select("_host").distinct()
    named = ~looks_like_ip(F.col("_host")) & F.contains("_host", F.lit("."))
    tails = hosts.where(named).select("_host", F.explode(host_suffixes(F.col("_host"))).alias("base"), F.size(F.split("_host", r"\.")).alias("_n"))
    # a wildcard needs the label that it stands for
    met = tails.join(parsed_rules(rules, rule_col), "base").where("labels <= _n")
    best = met.groupBy("_host").agg(F.max(F.struct("exception", "labels")).alias("_best"))
    split = let(F.when(named, F.coalesce(F.col("_best.labels"), F.lit(1))).otherwise(0), lambda k: _split(F.col("_host"), k))
    # written first, so that the join stands alone in its stage and a host of very many rows can be split
    done = settled(hosts.join(best, "_host", "left").select("_host", split.alias(into)))
    return keyed.join(done, "_host", "left").select(*rows.columns, into)
