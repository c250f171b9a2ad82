"""Distinct counts and quantiles from sketches that are kept by day and merged for any span.

A day's sketch is a few kilobytes whatever it counts, and sketches merge, so a span of days is answered
from its days alone. Errors are bounded by the sketches' sizes: of a distinct count the
relative standard error is about 1.04 / sqrt(2 ** ``lg_k``) (0.8 % here), of a quantile the
error of its rank is below ``RANK_ERROR`` (for a sketch of ``k`` = 400; smaller with larger ``k``).

Scale: day sketches are ordinary aggregates that combine before their shuffle; a span reads one row for each
of its days and keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, K = 14, 400
DISTINCT_ERROR, RANK_ERROR = 1.04 / 2 ** (LG_K / 2), 0.01


def by_day(rows: DataFrame, keys: Sequence[str], time: str, distinct: str, value: str, lg_k: int = LG_K, k: int = K) -> DataFrame:
    """(keys, day, n, distinct_sketch, value_sketch) of each key's days. Nulls are counted in n only; rows without a time belong to no day."""
    used = rows.where(F.col(time).isNotNull()).withColumn("day", F.to_date(time))
    return used.groupBy(*keys, "day").agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col(distinct), F.lit(lg_k)).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("value_sketch"))


def over_span(days: DataFrame, keys: Sequence[str], first: Column | None = None, last: Column | None = None) -> DataFrame:
    """(keys, n, distinct_sketch, value_sketch) of the days from ``first`` to ``last``, both included; mergeable again."""
    if first is not None:
        days = days.where(F.col("day") >= first)
    if last is not None:
        days = days.where(F.col("day") <= last)
    return days.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch").alias("value_sketch"))


def estimates(spans: DataFrame, keys: Sequence[str], shares: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """(keys, n, n_distinct, q_50, q_95, ...): estimates of merged sketches; quantiles of no values are null."""
    some = F.kll_sketch_get_n_double("value_sketch") > 0
    quantiles = [F.when(some, F.kll_sketch_get_quantile_double("value_sketch", F.lit(float(s)))).alias(f"q_{round(100 * s)}") for s in shares]
    return spans.select(*keys, "n", F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"), *quantiles)
