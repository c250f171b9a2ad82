"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are normalised, so cosine c is Euclidean distance sqrt(2 - 2c). A hash is
``floor((a.v + b) / width)`` with Gaussian ``a`` (2-stable) and uniform ``b``; a
table's bucket is the tuple of ``hashes`` such values, and there are ``tables`` of
them, all fixed by ``seed``. Two vectors are compared, by exact cosine in double
precision, if they share a bucket of at least one table and have the same label.
Hashes and tables follow from the number of vectors (``layout``): enough hashes that an
unrelated vector shares a bucket with a probability of 1 / (``SPARSE`` n), and enough
tables that a pair at the threshold shares one with a probability of ``RECALL``; at
cosine 0.95 a pair is missed about once in a thousand, at 0.98 practically never.

Scale: what a bucket holds by chance doesn't grow with the number of vectors n, so
comparisons of unrelated vectors grow with the number of tables only, as n ** 0.22.
Members alone in their bucket go before vectors are sent, and a vector takes along the bucket ids
(32 bits each) of the tables up to its bucket's only. A bucket's members are dealt into chunks of ``chunk`` vectors by row number,
and each pair of chunks is a task-sized piece of work of its own, so a hot bucket
(a third of all rows that are nearly alike) spreads over the cluster. A pair that
shares buckets of several tables is counted in the first of them only. Pieces give
out per-vector counts and a spanning forest, never the pairs. Equal vectors of one
label are first folded into one class, with its size as weight.

Edge cases: a vector that is null, empty, zero, or holds null or non-finite
components, and any with a null label, links with nothing and keeps itself.
Vectors of different length never link. Rows that repeat an id are one vector; if
their contents differ, the smallest (label, vector) counts. Each row of a null id has a row, of a null
component. Ids are whole numbers, or texts of them.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_whole_groups, matrix, settle, slices
from .graph import Forest, components

THRESHOLD = 0.93
WIDTH, SEED, CHUNK = 2.0, 20240, 512
RECALL, SPARSE = 0.97, 16
#: Rows and columns of a product computed at once.
BLOCK = 512
#: Hashes of vectors held at once, 8 bytes each.
HASHED = 1 << 22
#: Rows of a group that is compared together with others, and pairs compared so at once.
SMALL, PAIRS = 64, 1 << 15


def collision(distance: float, width: float) -> float:
    """Probability that one hash of two vectors at a distance is equal."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def layout(n: int, threshold: float = THRESHOLD, width: float = WIDTH, recall: float = RECALL) -> tuple[int, int]:
    """Tables and hashes for n vectors; unrelated ones are at right angles."""
    near, far = collision(math.sqrt(2 - 2 * min(threshold, 0.9999)), width), collision(math.sqrt(2), width)
    hashes = max(1, math.ceil(math.log(SPARSE * max(n, 2)) / -math.log(far)))
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**hashes))), hashes


def projections(dim: int, tables: int, hashes: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables * hashes)), rng.uniform(0, width, tables * hashes)


def bucket_ids(unit: np.ndarray, tables: int, hashes: int, width: float, seed: int) -> np.ndarray:
    """A 32-bit bucket id for each vector and table; at most ``HASHED`` hashes are held at once."""
    a, b = projections(unit.shape[1], tables, hashes, width, seed)
    parts = [np.zeros((0, tables), np.uint32)]
    for rows in np.array_split(unit, -(-len(unit) * tables * hashes // HASHED)) if len(unit) else []:
        q = np.floor((rows @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(len(rows), tables, hashes)
        out = np.full((len(rows), tables), unit.shape[1], np.uint64)
        for k in range(hashes):
            out = (out ^ q[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        parts.append((out >> np.uint64(32)).astype(np.uint32))
    return np.concatenate(parts)


def _usable(df: DataFrame) -> DataFrame:
    ok = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.col("label").isNotNull() & F.col("id").isNotNull()
    finite = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return df.where(ok & finite & F.exists("vec", lambda x: x != 0))


def _hashed(classes: DataFrame, tables: int, hashes: int, width: float, seed: int) -> DataFrame:
    schema = T.StructType([*classes.schema.fields, T.StructField("keys", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            vecs = [np.asarray(x, np.float64) for x in batch.column(batch.schema.get_field_index("vec")).to_pylist()]
            keys: list = [None] * len(vecs)
            for dim in {len(v) for v in vecs}:
                rows = [i for i, v in enumerate(vecs) if len(v) == dim]
                x = np.stack([vecs[i] for i in rows])
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for i, k in zip(rows, bucket_ids(x, tables, hashes, width, seed).view(np.int32)):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int32()))], names=[*batch.schema.names, "keys"])

    return classes.mapInArrow(run, schema)


def compare(left: np.ndarray, right: np.ndarray, left_keys: np.ndarray, right_keys: np.ndarray, t: int, threshold: float) -> np.ndarray:
    """Which pairs have the cosine, and share no bucket of a table before ``t``."""
    near = left @ right.T >= threshold - 1e-9
    i, j = np.nonzero(near)
    if len(i):
        # the products above only choose; the deciding cosine is that of the pair alone
        good = np.einsum("ij,ij->i", left[i], right[j]) >= threshold
        good &= left_keys[i, t] == right_keys[j, t]
        good &= ~(left_keys[i, :t] == right_keys[j, :t]).any(axis=1)
        near[i, j] = good
    return near


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _small(first: np.ndarray, size: np.ndarray, x: np.ndarray, keys: np.ndarray, t: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked rows (i, j) of many small groups at once; ``size`` rows from ``first`` on make a group."""
    row = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    after = np.repeat(first + size, size) - 1 - row
    for a, b in slices(after.tolist(), PAIRS):
        n = after[a:b]
        i = np.repeat(row[a:b], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        i, j = i[near], j[near]
        same = keys[i] == keys[j]
        at = t[i]
        good = same[np.arange(len(i)), at] & ~(same & (np.arange(keys.shape[1]) < at[:, None])).any(axis=1)
        yield i[good], j[good]


def _large(rows: np.ndarray, c: np.ndarray, d: np.ndarray, ids: np.ndarray, x: np.ndarray, keys: np.ndarray, t: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked rows (i, j) of one group: of its two chunks, or within one."""
    left, right, within = rows[c[rows] <= d[rows]], rows[c[rows] >= d[rows]], bool((c[rows] == d[rows]).all())
    for a in range(0, len(left), BLOCK):
        for b in range(0, len(right), BLOCK):
            i, j = left[a : a + BLOCK], right[b : b + BLOCK]
            near = compare(x[i], x[j], keys[i], keys[j], int(t[rows[0]]), threshold)
            if within:
                near &= ids[i][:, None] < ids[j][None, :]
            u, v = np.nonzero(near)
            yield i[u], j[v]


def _linked(rows: pa.Table, threshold: float) -> pa.RecordBatch | None:
    """(u, v, n) for the vectors of whole groups: a vector, the smallest one it is joined to here, how many vectors it links to."""
    ids, t, size, piece, c, d = (rows.column(k).to_numpy() for k in ("rep", "t", "size", "piece", "c", "d"))
    label = np.unique(np.asarray(rows.column("label").to_pylist(), object), return_inverse=True)[1]
    dims = pc.list_value_length(rows.column("vec")).to_numpy()
    # keys go up to a row's own table; what lies beyond is never looked at
    sizes = pc.list_value_length(rows.column("keys")).to_numpy()
    keys = np.zeros((len(ids), int(sizes.max())), np.int32)
    keys[np.arange(keys.shape[1]) < sizes[:, None]] = rows.column("keys").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    forest, links = Forest(), np.zeros(len(ids), np.int64)
    first = np.flatnonzero(np.diff(piece, prepend=piece[0] - 1))
    n = np.diff(np.append(first, len(piece)))
    small = (n <= SMALL) & (np.maximum.reduceat(c, first) == 0) & (np.maximum.reduceat(d, first) == 0)
    for dim in np.unique(dims).tolist():
        own = np.flatnonzero(dims == dim)
        x = np.zeros((len(ids), dim))
        x[own] = _unit(matrix(rows.column("vec").take(pa.array(own)), np.float64))
        # a bucket holds vectors of one length, unless two hashes fall together
        here = dims[first] == dim
        todo = [_small(first[small & here & (n > 1)], n[small & here & (n > 1)], x, keys, t, threshold)]
        todo += [_large(np.arange(a, a + k), c, d, ids, x, keys, t, threshold) for a, k in zip(first[~small & here].tolist(), n[~small & here].tolist())]
        for i, j in chain.from_iterable(todo):
            ok = (label[i] == label[j]) & (dims[i] == dims[j])
            i, j = i[ok], j[ok]
            np.add.at(links, i, size[j])
            np.add.at(links, j, size[i])
            for u, v in zip(ids[i].tolist(), ids[j].tolist()):
                forest.link(u, v)
    at = np.flatnonzero(links)
    if not len(at):
        return None
    roots = [forest.find(z) for z in ids[at].tolist()]
    return pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(roots, pa.int64()), pa.array(links[at], pa.int64())], names=["u", "v", "n"])


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tables: int | None = None, hashes: int | None = None, width: float = WIDTH, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).cast("string").alias("label"))
    # adding 0 makes -0.0 and 0.0 one value
    usable = _usable(rows).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))
    member = settle(usable.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("m")).select("id", "m.*", F.xxhash64("m.label", "m.vec").alias("h")))
    classes = member.groupBy("h", "label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    if tables is None or hashes is None:
        tables, hashes = layout(member.count(), threshold, width)
    classes = settle(_hashed(classes, tables, hashes, width, seed))
    keyed = classes.select("rep", F.posexplode("keys").alias("t", "key"), "label").select("rep", "t", F.xxhash64("t", "key", "label").alias("bucket"))
    counts = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    # a member's chunk comes from a hash of its id: no window over a hot bucket
    placed = keyed.join(counts, "bucket").withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    placed = placed.withColumn("c", F.pmod(F.xxhash64(F.lit(seed), "rep"), F.col("chunks")).cast("int"))
    pieces = placed.select("rep", "t", "bucket", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("d"))
    pieces = pieces.select("rep", "t", F.xxhash64("bucket", F.least("c", "d"), F.greatest("c", "d")).alias("piece"), F.col("c").alias("c"), F.col("d").alias("d"))
    full = pieces.join(classes.select("rep", "label", "vec", "keys", "size"), "rep").withColumn("keys", F.slice("keys", F.lit(1), F.col("t") + 1))

    found = settle(map_whole_groups(full, "piece", lambda rows: _linked(rows, threshold), "u long, v long, n long"))
    links = found.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("other"))
    comp = components(found.where("u <> v").select("u", "v"))
    of_class = classes.select("h", "label", "vec", "rep", "size").join(links, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    of_class = of_class.select("h", "label", "vec", (F.col("size") - 1 + F.coalesce("other", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    per_id = member.join(of_class, ["h", "label", "vec"]).select("id", "n_links", "component")
    # a null id is no id: each such row stays
    out = rows.select("id").where("id is not null").distinct().join(per_id, "id", "left").unionByName(rows.select("id").where("id is null"), allowMissingColumns=True)
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
