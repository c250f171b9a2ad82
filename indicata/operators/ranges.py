"""Addresses in ranges, v4 and v6: ranges cut into prefixes, met by equality, the longest prefix counts.

An address is a text of its bits (32 or 128 signs), so a prefix is a text that others start with. A
range from one address to another is the least set of prefixes that covers it. An
address is looked up under its prefixes of the lengths that occur in the table.

Scale: one equi-join, of as many rows as distinct addresses times lengths that occur (160 at most);
no range is ever compared with all addresses. A prefix that very many addresses share is
an ordinary skewed key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import IPV4, IPV6, let

V4, V6 = 32, 128


def _group_bits(group: Column) -> Column:
    return F.lpad(F.conv(group, 16, 2), 16, "0")


def _octets(address: Column) -> Column:
    return F.transform(F.split(address, r"\."), lambda o: F.lpad(F.conv(o, 10, 2), 8, "0"))


def _v6_bits(address: Column) -> Column:
    # a dotted end stands for two groups
    dotted = F.regexp_extract(address, r"([0-9]+\.[0-9.]+)$", 1)
    octet = lambda k: F.split(dotted, r"\.")[k].cast("int")
    two = F.concat(F.hex(octet(0) * 256 + octet(1)), F.lit(":"), F.hex(octet(2) * 256 + octet(3)))
    plain = F.when(dotted == "", address).otherwise(F.concat(F.substring(address, F.lit(1), F.length(address) - F.length(dotted)), two))
    groups = lambda text: F.filter(F.split(text, ":"), lambda g: g != "")

    def bits(value: Column) -> Column:
        head, tail = groups(F.substring_index(value, "::", 1)), groups(F.when(F.contains(value, F.lit("::")), F.substring_index(value, "::", -1)).otherwise(""))
        zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(head) - F.size(tail), F.lit(0)))
        return F.array_join(F.transform(F.concat(head, zeros, tail), _group_bits), "")

    return let(plain, bits)


def address_bits(address: Column) -> Column:
    """The bits of an address as text; null for anything else. A zone (``%eth0``) is left out."""
    bare = F.regexp_replace(F.trim(address), "%[^%/]+$", "")
    return F.when(bare.rlike(f"^{IPV4}$"), F.array_join(_octets(bare), "")).when(bare.rlike(f"^{IPV6}$"), _v6_bits(bare))


def network_prefix(cidr: Column) -> Column:
    """The fixed bits of a network written as address/length (an address alone is itself); null for anything else."""
    width = F.regexp_extract(F.trim(cidr), r"/0*([0-9]{1,3})$", 1)
    bits = address_bits(F.regexp_replace(F.trim(cidr), r"/[0-9]+$", ""))
    slash = F.contains(cidr, F.lit("/"))
    length = F.when(slash, width.try_cast("int")).otherwise(F.length(bits))
    return F.when(length <= F.length(bits), F.substring(bits, F.lit(1), length))


def range_prefixes(first: Column, last: Column) -> Column:
    """The least prefixes that cover all addresses between two, both included, given as bits; null where there is none.

    Beyond the bits that both share, what lies above ``first`` are its bits up to each 0
    with a 1 instead, and what lies below ``last`` its bits up to each 1 with a 0
    instead; 0s at the end of the first and 1s at the end of the last belong to one prefix.
    """

    def cut(x: Column) -> Column:
        a, b, n = x["a"], x["b"], F.length(x["a"])
        common = F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))

        def side(bits: Column, filler: str, other: str, p: Column) -> Column:
            kept = F.greatest(F.length(F.rtrim(bits, F.lit(filler))), p + 1)
            steps = F.filter(F.sequence(F.lit(1), n), lambda i: (i > p + 1) & (i <= kept) & (F.substring(bits, i, F.lit(1)) == filler))
            return F.concat(F.array(F.substring(bits, F.lit(1), kept)), F.transform(steps, lambda i: F.concat(F.substring(bits, F.lit(1), i - 1), F.lit(other))))

        def parts(p: Column) -> Column:
            whole = (F.rtrim(F.substring(a, p + 1, n), F.lit("0")) == "") & (F.rtrim(F.substring(b, p + 1, n), F.lit("1")) == "")
            return F.when(whole, F.array(F.substring(a, F.lit(1), p))).otherwise(F.concat(side(a, "0", "1", p), side(b, "1", "0", p)))

        return let(common, parts)

    return F.when((F.length(first) == F.length(last)) & (first <= last), let(F.struct(first.alias("a"), last.alias("b")), cut))


def prefixes_of(ranges: DataFrame, id_col: str, *, cidr_col: str | None = None, first_col: str | None = None, last_col: str | None = None) -> DataFrame:
    """(range_id, v6, prefix) of ranges given as networks, or as first and last address; unusable ones give no rows."""
    if cidr_col:
        bits = address_bits(F.regexp_replace(F.trim(F.col(cidr_col)), r"/[0-9]+$", ""))
        rows = ranges.select(F.col(id_col).alias("range_id"), F.length(bits).alias("n"), network_prefix(F.col(cidr_col)).alias("prefix"))
    else:
        sides = ranges.select(F.col(id_col).alias("range_id"), address_bits(F.col(first_col)).alias("a"), address_bits(F.col(last_col)).alias("b"))
        rows = sides.select("range_id", F.length("a").alias("n"), F.explode(range_prefixes(F.col("a"), F.col("b"))).alias("prefix"))
    return rows.where("prefix is not null").select("range_id", (F.col("n") == V6).alias("v6"), "prefix")


def covering(addresses: DataFrame, prefixes: DataFrame, address_col: str = "address") -> DataFrame:
    """``addresses`` with range_id and prefix_length of the longest prefix that covers each; null where none does.

    Several ranges of one longest prefix: the smallest id. Nulls and what is no address
    are in no range. All rows stay.
    """
    lengths = prefixes.select("v6", F.length("prefix").alias("len")).distinct()
    # two families of at most 33 and 129 lengths: a list of a fixed size
    known = [(r["v6"], r["len"]) for r in lengths.collect()]
    distinct = addresses.select(F.col(address_col).alias("_address")).distinct().withColumn("_bits", address_bits(F.col("_address"))).where("_bits is not null")
    of = lambda v6: F.array(*[F.lit(n) for six, n in sorted(known) if six == v6]).cast("array<int>")
    v6 = F.length("_bits") == V6
    asked = distinct.select("_address", v6.alias("v6"), F.explode(F.transform(F.when(v6, of(True)).otherwise(of(False)), lambda n: F.substring(F.col("_bits"), F.lit(1), n))).alias("prefix"))
    held = prefixes.groupBy("v6", "prefix").agg(F.min("range_id").alias("range_id"))
    best = asked.join(held, ["v6", "prefix"]).groupBy("_address").agg(F.max_by(F.struct(F.col("range_id"), F.length("prefix").alias("prefix_length")), F.length("prefix")).alias("b"))
    out = addresses.withColumn("_address", F.col(address_col)).join(best, "_address", "left")
    return out.select(*addresses.columns, "b.range_id", "b.prefix_length")
