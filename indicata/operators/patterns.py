"""Many fixed patterns in texts, of which the first by priority counts.

All patterns of a block make one automaton, so a text is read once whatever their number.
A worker builds a block's automaton once and keeps it for its later tasks.

Scale: texts aren't shuffled for a single block. Repeated patterns are brought together first, so only
different ones count. They are cut into blocks of about ``BLOCK_BYTES``, so what goes to the workers at
once is bounded; several blocks are several passes, whose findings (a row for each text with any) are
brought together by id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.batches import by_bytes

#: Bytes of patterns in one automaton.
BLOCK_BYTES = 8 << 20
_FOUND = "priority long, label string, pattern string, n_patterns long"
#: The automaton that this worker holds, by the id of its block.
_held: dict[str, object] = {}


def automaton(block: str, rows: list[tuple[str, int, str | None]]):
    """The automaton of (pattern, priority, label) of different patterns."""
    import ahocorasick

    if block not in _held:
        _held.clear()
        built = ahocorasick.Automaton()
        for pattern, priority, label in rows:
            built.add_word(pattern, (priority, label, pattern))
        built.make_automaton()
        _held[block] = built
    return _held[block]


def _best(built, text: str | None) -> tuple:
    found = {value for _, value in built.iter(text)} if text and len(built) else ()
    if not found:
        return None, None, None, 0
    priority, label, pattern = min(found, key=lambda f: (f[0], f[2]))
    return priority, label, pattern, len(found)


def first_pattern(rows: DataFrame, patterns: DataFrame, *, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per text: id, priority, label, pattern, n_patterns.

    ``patterns`` has the columns pattern, priority (a whole number, the least counts first; ties:
    the pattern that is smaller in code point order) and label. ``n_patterns`` is the number of
    different patterns found. Null and empty patterns are passed over; a null text
    holds none. Several blocks bring ids together, so there ids must be unique.
    """
    spark = rows.sparkSession
    usable = patterns.select(F.col("pattern").cast("string"), F.col("priority").cast("long"), F.col("label").cast("string")).where("pattern <> '' and priority is not null")
    # of a repeated pattern, the least (priority, label) counts, null labels last
    usable = usable.groupBy("pattern").agg(F.min(F.struct("priority", F.col("label").isNull().alias("unnamed"), "label")).alias("b")).select("pattern", "b.priority", "b.label")
    total = usable.agg(F.coalesce(F.sum(F.octet_length("pattern") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    texts = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    passes = []
    for k in range(blocks):
        own = usable if blocks == 1 else usable.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast([tuple(r) for r in own.collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, block=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            built = automaton(block, shared.value)
            for batch in by_bytes(batches, "text"):
                columns = zip(*[_best(built, t) for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64())))], names=["id", "priority", "label", "pattern", "n_patterns"])

        passes.append(texts.mapInArrow(run, f"id {kind}, {_FOUND}"))
    if blocks == 1:
        return passes[0].withColumnRenamed("id", id_col)
    every = passes[0].select("id", F.lit(True).alias("row"), "priority", "label", "pattern", "n_patterns")
    for p in passes[1:]:
        every = every.unionByName(p.where("n_patterns > 0").withColumn("row", F.lit(False)))
    best = F.min(F.when(F.col("n_patterns") > 0, F.struct("priority", "pattern", "label")))
    out = every.groupBy("id").agg(best.alias("b"), F.sum("n_patterns").alias("n_patterns"))
    return out.select(F.col("id").alias(id_col), "b.priority", "b.label", "b.pattern", "n_patterns")
