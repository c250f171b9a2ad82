"""Versions of a list or feed: what changed between two, and a history that answers for any of them.

A history holds each row with the versions it was valid in: from ``valid_from`` on, and before
``valid_to`` (null: still). A new version is met with the open rows by key, in one full outer
join, so a reload costs as much as the list, however many versions there were.

Scale: one shuffle of the open rows and of the new version, by key. Closed rows are only passed on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FROM, TO = "valid_from", "valid_to"


def _by_key(version: DataFrame, keys: Sequence[str], into: str) -> DataFrame:
    """One row for each key: of several, the one that is greatest in the other columns."""
    rest = [c for c in version.columns if c not in keys]
    return version.groupBy(*keys).agg(F.max(F.struct(F.lit(True).alias("_there"), *rest)).alias(into))


def _met(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _old, _new) of all keys of both; null keys are keys like any other."""
    a, b = _by_key(old, keys, "_old").alias("a"), _by_key(new, keys, "_new").alias("b")
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    there = F.col("_new").isNotNull()
    return a.join(b, same, "full").select(*[F.when(there, F.col(f"b.{k}")).otherwise(F.col(f"a.{k}")).alias(k) for k in keys], "_old", "_new")


def _content(row: str, names: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"{row}.{n}").alias(n) for n in names])


def changes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, change, old, new) of rows that differ: insert, delete or update; old and new are structs of the other columns, null where there is none."""
    rest = [c for c in new.columns if c not in keys]
    met = _met(old, new, keys)
    kind = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(~_content("_old", rest).eqNullSafe(_content("_new", rest)), "update")
    out = met.withColumn("change", kind).where("change is not null")
    side = lambda row: F.when(F.col(row).isNotNull(), _content(row, rest))
    return out.select(*keys, "change", side("_old").alias("old"), side("_new").alias("new"))


def first_version(snapshot: DataFrame, keys: Sequence[str], version: int) -> DataFrame:
    """The history of a single version."""
    rest = [c for c in snapshot.columns if c not in keys]
    rows = _by_key(snapshot, keys, "_new").select(*keys, *[F.col(f"_new.{c}") for c in rest])
    return rows.select(*snapshot.columns, F.lit(version).cast("long").alias(FROM), F.lit(None).cast("long").alias(TO))


def with_version(history: DataFrame, snapshot: DataFrame, keys: Sequence[str], version: int) -> DataFrame:
    """The history after a reload: rows that are gone or changed end at ``version``, new and changed ones begin there.

    ``version`` must be later than those in the history; the columns of both must be the same.
    """
    names = snapshot.columns
    rest = [c for c in names if c not in keys]
    closed, live = history.where(F.col(TO).isNotNull()), history.where(F.col(TO).isNull())
    met = _met(live.drop(TO), snapshot, keys)
    same = _content("_old", rest).eqNullSafe(_content("_new", rest)) & F.col("_old").isNotNull() & F.col("_new").isNotNull()
    none = F.lit(None).cast("long")
    row = lambda side, start, end: F.struct(*[F.col(k) for k in keys], *[F.col(f"{side}.{c}").alias(c) for c in rest], start.cast("long").alias(FROM), end.cast("long").alias(TO))
    old, new = row("_old", F.col(f"_old.{FROM}"), F.when(~same, version)), row("_new", F.lit(version), none)
    rows = F.array_compact(F.array(F.when(F.col("_old").isNotNull(), old), F.when(F.col("_new").isNotNull() & ~same, new)))
    return closed.unionByName(met.select(F.explode(rows).alias("r")).select("r.*"))


def at_version(history: DataFrame, version: int) -> DataFrame:
    """The list as it was at a version."""
    return history.where((F.col(FROM) <= version) & (F.col(TO).isNull() | (F.col(TO) > version))).drop(FROM, TO)
