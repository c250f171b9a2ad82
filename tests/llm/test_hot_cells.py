"""Cells of many fingerprints: no link is lost, whatever their size."""

import random

import numpy as np
import pytest

from indicata.llm import graph, simhash


def parts(n, links):
    forest = graph.Forest()
    for i in range(n):
        forest.find(i)
    for i, j in links:
        forest.link(int(i), int(j))
    return [forest.find(i) for i in range(n)]


def brute(fps, most):
    far = simhash._apart(fps[:, None], fps[None])
    return parts(len(fps), np.argwhere(far <= most))


def flipped(rng, lanes, bits):
    out = list(lanes)
    for b in rng.sample(range(128), bits):
        out[b // 64] ^= 1 << b % 64
    return out


@pytest.mark.parametrize("seed", range(12))
def test_near_links_join_what_all_pairs_join(seed):
    rng = random.Random(seed)
    most, rows = 31, []
    for _ in range(rng.choice([1, 3, 12])):
        centre = [rng.getrandbits(64), rng.getrandbits(64)]
        for _ in range(rng.choice([1, 5, 60])):
            # steps of a walk, so that ends are far from each other and only neighbours are near
            centre = flipped(rng, centre, rng.choice([0, 5, 30, 40]))
            rows += [flipped(rng, centre, rng.choice([0, 0, 3, 20])) for _ in range(rng.choice([1, 4]))]
    rng.shuffle(rows)
    fps = np.array(rows, np.uint64)
    assert parts(len(fps), simhash._near_links(fps, most)) == brute(fps, most)


def test_near_links_of_a_large_group_of_near_copies():
    rng = random.Random(1)
    centre = [rng.getrandbits(64), rng.getrandbits(64)]
    fps = np.array([flipped(rng, centre, rng.randrange(12)) for _ in range(30_000)], np.uint64)
    assert len(set(parts(len(fps), simhash._near_links(fps, 31)))) == 1


@pytest.mark.parametrize(("hot", "cell_rows"), [(32, 50_000), (2, 50_000), (2, 25), (0, 1)])
def test_candidates_of_hot_cells(spark, monkeypatch, hot, cell_rows):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "CELL_ROWS", cell_rows)
    rng = random.Random(2)
    bits, count, lanes, most, _ = simhash.layout(1000)
    base = [rng.getrandbits(64) for _ in range(lanes)]
    # thirteen classes of one cell: 100 is near 8 only, and both are far from the smallest
    rows = {}
    for key in range(1, 13):
        own = list(base)
        for b in rng.sample(range(bits, 128), 40):
            own[b // 64] ^= 1 << b % 64
        rows[key] = own
    near = list(rows[8])
    for b in rng.sample(range(bits, 128), 5):
        near[b // 64] ^= 1 << b % 64
    rows[100] = near
    rows |= {1000 + k: [rng.getrandbits(64) for _ in range(lanes)] for k in range(40)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    classes = spark.createDataFrame([(k, [signed(x) for x in v]) for k, v in rows.items()], "key long, fp array<long>")
    found = simhash._candidates(simhash._entries(classes, bits, count, lanes), most)
    order = sorted(rows)
    got = parts(len(order), [(order.index(r.u), order.index(r.v)) for r in found.collect()])
    fps = np.array([rows[k][: simhash.SHIPPED] for k in order], np.uint64)
    want = brute(fps, most)
    assert got[order.index(100)] == got[order.index(8)]
    # all links between the thirteen, which share a cell; unlike ones may meet in another cell or not
    assert got == want


def test_merged_forests(spark):
    packed = [([k % 50, k], [0, k % 50]) for k in range(400)]
    df = spark.createDataFrame(packed, "u array<long>, v array<long>")
    for most in (500_000, 10):
        graph.MERGED, old = most, graph.MERGED
        try:
            found = [(r.u, r.v) for r in graph.merged(df).collect()]
        finally:
            graph.MERGED = old
        assert len(set(parts(400, found))) == 1
    assert graph.merged(df.limit(0)).collect() == []
