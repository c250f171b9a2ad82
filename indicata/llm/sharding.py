"""Shards by jump consistent hashing.

A row's stable key (its id as text) gives 64 bits, and these a shard: a chain of jumps
through ever more shards, of which the last one below the number of shards counts. Nothing
else decides, so no ring table is held, and one more shard takes its share of rows
from all others and moves none between them.

``slot`` numbers a shard's rows from 0 without a gap, in the order of a digest of id,
text checksum and size: a stable order that is mixed well and doesn't hang on files or
tasks. Equal texts of different ids are rows of their own, wherever their ids lead them;
with ``key_cols`` a shard can be decided by other columns, such as a group's id, so that
a group stays together.

Scale: texts are read once and never shuffled; what is dealt is a row of some 100 bytes for
each distinct (id, checksum, size), counted before it is dealt. Slots are running sums
within (shard, digest prefix), ``PREFIX`` hex digits of it, plus an offset from a table of as
many rows as there are such pairs, so neither a shard nor an id that very many rows
have lands in one task; copies of one row are numbered in pieces of ``PIECE``. All of it
are built-in functions.

Edge cases: a null text has 0 bytes and the checksum 0, like an empty one; a null id is dealt
like an empty text as id, and stays null. Rows that repeat an id, a checksum and a size are
alike, and each gets a slot. An empty table has no rows. Other columns of the table are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import settle

SHARDS = 40
#: Fixed value of the method: the multiplier of its generator.
MULTIPLIER = 2862933555777941757
#: Jumps that nearly every chain ends within; others go on from there.
FIRST_JUMPS = 32
#: Hex digits of the digest within which slots are summed, and copies of a row numbered at once.
PREFIX, PIECE = 3, 1 << 16

_LOW16, _LOW32 = (1 << 16) - 1, (1 << 32) - 1


def key_halves(*keys: Column) -> Column:
    """64 bits of a key's text, as a struct of two unsigned halves (hi, lo); nulls count as empty."""
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return F.struct(half(1).alias("hi"), half(9).alias("lo"))


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's next state, key * MULTIPLIER + 1 modulo 2^64, in halves: no product or sum leaves a signed long."""
    high, low = divmod(MULTIPLIER, 1 << 32)
    low_high, low_low = divmod(low, 1 << 16)
    p = lo * low_low + 1
    s = F.shiftright(p, 16) + lo * low_high
    carry = F.shiftright(s, 16) + lo * high + hi * low_low + F.shiftleft((hi * low_high).bitwiseAND(_LOW16), 16)
    return carry.bitwiseAND(_LOW32), F.shiftleft(s.bitwiseAND(_LOW16), 16) + p.bitwiseAND(_LOW16)


def jump(halves: Column, shards: int) -> Column:
    """Struct of b, the shard, and j, the first jump that leads beyond the shards."""
    if shards < 1:
        raise ValueError("there must be a shard")

    def step(state: Column, _: Column) -> Column:
        hi, lo = _next(state["hi"], state["lo"])
        moved = let(F.struct(hi.alias("hi"), lo.alias("lo")), lambda k: F.struct(state["j"].alias("b"), ((state["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(k["hi"], 1) + 1).cast("double"))).cast("long").alias("j"), k["hi"].alias("hi"), k["lo"].alias("lo")))
        return F.when(state["j"] < shards, moved).otherwise(state)

    walk = lambda state, steps: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), halves["hi"].alias("hi"), halves["lo"].alias("lo"))
    # every jump leads at least one shard further, so there are at most as many as shards
    whole = walk(start, min(shards, FIRST_JUMPS))
    return whole if shards <= FIRST_JUMPS else let(whole, lambda s: F.when(s["j"] >= shards, s).otherwise(walk(s, shards)))


def shard_of(keys: Sequence[Column] | Column, shards: int = SHARDS) -> Column:
    """The shard of a row, from 0, by its stable key."""
    keys = [keys] if isinstance(keys, Column) else list(keys)
    return jump(key_halves(*keys), shards)["b"].cast("int")


def place(docs: DataFrame, shards: int = SHARDS, *, id_col: str = "doc_id", text_col: str = "text", key_cols: Sequence[str] | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    own, text = F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(own.alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), jump(key_halves(*[F.col(c) for c in key_cols or (id_col,)]), shards).alias("at"))
    grown = F.when(F.col("at.j") == shards, shards).otherwise(F.col("at.b"))  # the chain for one more shard is the same, and one jump longer or not
    rows = rows.select("doc_id", "size", "text_crc32", F.col("at.b").cast("int").alias("shard"), grown.cast("int").alias("grown_shard"))
    alike = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"), F.col("size").cast("string")))
    alike = settle(alike.withColumn("digest", order).withColumn("prefix", F.substring("digest", 1, PREFIX)))
    within = Window.partitionBy("shard", "prefix").orderBy("digest", F.col("doc_id").cast("string"), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("shard").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = alike.groupBy("shard", "prefix").agg(F.sum("n").alias("n")).select("shard", "prefix", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = alike.withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0))).join(offsets, ["shard", "prefix"]).withColumn("first", F.col("first") + F.col("offset"))
    few = numbered.where(F.col("n") <= PIECE).withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
    many = numbered.where(F.col("n") > PIECE).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE))))
    many = many.repartition("digest", "piece").withColumn("slot", F.explode(F.sequence(F.col("first") + F.col("piece") * PIECE, F.col("first") + F.least((F.col("piece") + 1) * PIECE, "n") - 1)))
    out = few.unionByName(many.drop("piece"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, *, id_col: str = "doc_id", key_cols: Sequence[str] | None = None, files: int = 1) -> None:
    """Writes whole rows as Parquet under ``path``/shard=N, in about ``files`` files a shard.

    A shard's rows are spread over ``files`` tasks by a hash of all columns that have one,
    so a shard is never one task's work where it is large.
    """
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    column = "shard"
    if column in docs.columns:
        raise ValueError("the table has a column named shard already")
    placed = docs.withColumn(column, shard_of([F.col(c) for c in key_cols or (id_col,)], shards))
    placed.repartition(shards * files, column, F.pmod(F.xxhash64(*hashed), F.lit(files))).write.partitionBy(column).parquet(path)


def _crc32_sql(hex_pairs: str) -> str:
    """DuckDB expression: the CRC-32 of a list of two-digit hex strings, by four bits at a time."""
    small = []
    for i in range(16):
        c = i
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        small.append(c)
    table = "[" + ", ".join(map(str, small)) + "]::bigint[]"
    nibbles = f"list_transform({hex_pairs}, lambda x: ('0x' || x)::bigint)"
    return f"xor(list_reduce({nibbles}, lambda c, x: xor(c >> 4, ({table})[(xor(c, x) & 15) + 1]), 4294967295::bigint), 4294967295)"


def text_crc32_sql(text: str) -> str:
    """DuckDB expression: the CRC-32 of a text's UTF-8 bytes; low half of each byte first."""
    return _crc32_sql(f"regexp_extract_all(regexp_replace(hex(encode({text})), '(.)(.)', '\\2\\1', 'g'), '.')")


ORACLE_SQL = f"""
with recursive own as (
  select row_number() over () as row, doc_id, strlen(coalesce(text, '')) + 16 as size, {text_crc32_sql("coalesce(text, '')")} as text_crc32,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 16))::ubigint::hugeint as k from documents
), chain as (
  select row, k, -1::bigint as b, 0::bigint as j from own
  union all
  select row, (k * {MULTIPLIER} + 1) % 18446744073709551616 as k, j as b,
    trunc((j + 1)::double * (2147483648::double / ((((k * {MULTIPLIER} + 1) % 18446744073709551616) // 8589934592) + 1)::double))::bigint as j
  from chain where j < {SHARDS + 1}
), placed as (
  select row, max(b) filter (where b < {SHARDS}) as shard, max(b) filter (where b <= {SHARDS}) as grown_shard from chain group by row
)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard::int as shard, grown_shard::int as grown_shard,
  row_number() over (partition by shard order by md5(concat_ws(':', coalesce(doc_id::varchar, ''), text_crc32::varchar, size::varchar)), doc_id::varchar, text_crc32, size) - 1 as slot
from own join placed using (row)
"""
