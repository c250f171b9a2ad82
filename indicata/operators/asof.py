"""As-of joins: each event with the last record of its key that was known by then.

Events and records are put into one table by key and swept in order of time; Spark has no join
of this kind. A key of many rows is cut into blocks of time, each swept by itself, and what is known
at a block's end is carried into the next ones: per block, one record, found by an aggregate.

Scale: one shuffle of events and records by (key, block). Only large keys (``time_blocks``) have
several blocks, up to ``BLOCKS``; their bounds are quantiles of their own times, so a key that holds
a third of all rows is spread over that many tasks. Rows without a key or a time know nothing and
aren't dealt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settled

#: A key is large if it has more rows than a share of all, which a quarter of a task has on average, and than so many.
LEAST_LARGE = 1_000
#: Blocks of a key at most, and large keys that are sent to all tasks.
BLOCKS, FEW = 256, 10_000


def time_blocks(rows: DataFrame, hot: int | None = None) -> DataFrame | None:
    """(_k, bounds): the times at which the blocks of a large key start, but for the first; None if no key is large.

    There are at most four times as many large keys as the shuffle has partitions, whatever the data. They go to all
    tasks where they are ``FEW`` at most, so that no table is dealt by them.
    """
    if hot is None:
        hot = max(LEAST_LARGE, rows.count() // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    large = rows.groupBy("_k").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    known = large.limit(FEW + 1).collect()
    if not known:
        return None
    few = len(known) <= FEW
    small = lambda df: F.broadcast(df) if few else df
    if few:
        large = rows.sparkSession.createDataFrame(known, large.schema)
    shares = F.array(*[F.lit(k / BLOCKS) for k in range(1, BLOCKS)])
    times = rows.join(small(large), "_k").groupBy("_k").agg(F.percentile_approx("_us", shares, F.lit(1000)).alias("q"), F.max("n").alias("n"))
    # of all quantiles a key takes as many as it needs
    wanted = F.least(F.lit(BLOCKS), F.ceil(F.col("n") / hot))
    picked = F.transform(F.sequence(F.lit(1), F.greatest(wanted - 1, F.lit(1))), lambda k: F.get("q", F.floor(k * BLOCKS / wanted).cast("int") - 1))
    return small(times.select("_k", F.array_distinct(picked).alias("bounds")))


def as_of(events: DataFrame, records: DataFrame, *, keys: Sequence[str], event_time: str, record_time: str, columns: Sequence[str], into: str = "known", hot: int | None = None) -> DataFrame:
    """``events`` with the struct ``into`` of the record's time and ``columns``; null where none was known.

    A record counts for events of its own time and later, until the next one. Of several records
    of a key at one time, the one that is greatest in ``columns`` counts. ``keys`` are the
    names of both sides' key columns. All events stay, repeated ones too.
    """
    payload = F.struct(F.col(record_time).alias(record_time), *[F.col(c).alias(c) for c in columns])
    usable = lambda df, at: df.where(F.col(at).isNotNull() & ~F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)))
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    one = usable(events, event_time).select(key.alias("_k"), F.unix_micros(F.col(event_time).cast("timestamp")).alias("_us"), F.struct(*events.columns).alias("_event"))
    two = usable(records, record_time).select(key.alias("_k"), F.unix_micros(F.col(record_time).cast("timestamp")).alias("_us"), payload.alias("_record"))
    both = one.unionByName(two, allowMissingColumns=True)
    bounds = time_blocks(both.select("_k", "_us"), hot)
    if bounds is None:
        cut = both.withColumn("_block", F.lit(0).cast("long"))
    else:
        block = F.when(F.col("bounds").isNull(), 0).otherwise(F.size(F.filter("bounds", lambda b: b <= F.col("_us")))).cast("long")
        cut = both.join(bounds, "_k", "left").withColumn("_block", block).drop("bounds")
    order = Window.partitionBy("_k", "_block").orderBy("_us", F.col("_event").isNotNull(), "_record").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = cut.withColumn("_own", F.last("_record", ignorenulls=True).over(order)).where(F.col("_event").isNotNull())
    if bounds is None:
        known = swept.select("_event.*", F.col("_own").alias(into))
    else:
        # what the blocks before one knew: a row for each block of a large key
        keys_of = bounds.select("_k")
        ends = cut.where("_record is not null").join(keys_of, "_k", "left_semi").groupBy("_k", "_block").agg(F.max(F.struct("_us", "_record")).alias("end"))
        starts = cut.join(keys_of, "_k", "left_semi").select("_k", "_block").distinct().join(ends, ["_k", "_block"], "left")
        earlier = Window.partitionBy("_k").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        carried = starts.select("_k", "_block", F.last("end._record", ignorenulls=True).over(earlier).alias("_before"))
        known = swept.join(carried, ["_k", "_block"], "left").select("_event.*", F.coalesce("_own", "_before").alias(into))
    rest = events.where(F.col(event_time).isNull() | F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)))
    return known.unionByName(rest.withColumn(into, F.lit(None).cast(known.schema[into].dataType)))


def running_counts(rows: DataFrame, *, keys: Sequence[str], time: str, into: str = "upto", hot: int | None = None) -> DataFrame:
    """(keys, time, into): for each time of a key, how many of its rows are no later.

    Rows are counted by time first. A large key's blocks are counted by themselves, and what earlier
    blocks hold is added, so no key is swept by one task. Rows without a key or a time don't count.
    """
    there = rows.where(F.col(time).isNotNull() & ~F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)))
    each = settled(there.groupBy(*keys, F.col(time).alias(time)).agg(F.count("*").alias("_n")))
    each = each.select(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("_k"), F.unix_micros(F.col(time).cast("timestamp")).alias("_us"), F.col(time), "_n")
    bounds = time_blocks(each.select("_k", "_us"), hot)
    if bounds is None:
        cut = each.withColumn("_block", F.lit(0).cast("long"))
    else:
        block = F.when(F.col("bounds").isNull(), 0).otherwise(F.size(F.filter("bounds", lambda b: b <= F.col("_us")))).cast("long")
        cut = each.join(bounds, "_k", "left").withColumn("_block", block).drop("bounds")
    order = Window.partitionBy("_k", "_block").orderBy("_us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = cut.withColumn("_own", F.sum("_n").over(order))
    if bounds is not None:
        earlier = Window.partitionBy("_k").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        held = cut.join(bounds.select("_k"), "_k", "left_semi").groupBy("_k", "_block").agg(F.sum("_n").alias("_sum"))
        before = held.select("_k", "_block", F.sum("_sum").over(earlier).alias("_before"))
        swept = swept.join(before, ["_k", "_block"], "left").withColumn("_own", F.col("_own") + F.coalesce("_before", F.lit(0)))
    return swept.select(*[F.col(f"_k.k{i}").alias(k) for i, k in enumerate(keys)], time, F.col("_own").alias(into))


def counts_before(rows: DataFrame, *, keys: Sequence[str], time: str, seconds: Sequence[int], hot: int | None = None) -> DataFrame:
    """``rows`` with last_N for each N of ``seconds``: rows of the same key within the N seconds up to the row's time, itself included.

    A count is that up to the time less that before its window. Each time of a key is looked up once, for itself and for
    the starts of its windows, in the key's running counts. Rows without a key or a time keep null counts.
    """
    known = settled(running_counts(rows, keys=keys, time=time, hot=hot))
    starts = [F.struct(F.lit(n).alias("_window"), (F.col(time) - F.make_dt_interval(secs=F.lit(n)) - F.expr("interval 1 microsecond")).alias("_start")) for n in seconds]
    probes = known.select(*keys, F.col(time).alias("_at"), F.col("upto").alias("_upto"), F.explode(F.array(*starts)).alias("s")).select(*keys, "_at", "_upto", "s.*")
    met = as_of(probes, known, keys=keys, event_time="_start", record_time=time, columns=["upto"], into="_from", hot=hot)
    counts = met.groupBy(*keys, "_at").agg(*[F.max(F.when(F.col("_window") == n, F.col("_upto") - F.coalesce("_from.upto", F.lit(0)))).alias(f"last_{n}") for n in seconds])
    counts = counts.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_at", *[f"last_{n}" for n in seconds])
    same = F.col(time) == F.col("_at")
    for i, k in enumerate(keys):
        same &= F.col(k) == F.col(f"_key{i}")
    return rows.join(counts, same, "left").select(*[rows[c] for c in rows.columns], *[f"last_{n}" for n in seconds])
