"""Slices of Arrow batches, and statements that draw inputs from given tables."""

import pyarrow as pa
import pytest

from indicata.plans import drawn
from indicata.sources.batches import by_bytes


@pytest.mark.parametrize("limit", [1, 5, 1 << 20])
def test_slices_hold_every_row_once(limit):
    payload = [b"", None, b"abc", b"x" * 10, b"", b"yz", None, b"w" * 4]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(payload, pa.binary())], names=["i", "p"]), pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary())], names=["i", "p"])]
    out = list(by_bytes(batches, "p", limit))
    assert [x for b in out for x in b.column(0).to_pylist()] == list(range(8)) and all(b.num_rows for b in out)
    assert all(b.num_rows == 1 or sum(len(x or b"") for x in b.column(1).to_pylist()) <= limit for b in out)


def test_drawn_values_are_picked_by_key(spark):
    sql = f"select id, {drawn.pick('id', ['a', None, drawn._Sql(drawn.text('id'))])} as v, {drawn.part('id', 3)} as q, {drawn.numbered('x{n}y{n}', drawn.text('id'))} as n from range(7)"
    got = [tuple(r) for r in spark.sql(sql).collect()]
    assert got == [(i, ("a", None, str(i))[i % 3], i // 3, f"x{i}y{i}") for i in range(7)]
