"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has bit k set if more than half of its shingles' hashes have it.
Fingerprints are cut into segments; each is stored under the value of every segment,
and looks up the small Hamming ball around each of its own values. What a lookup
fetches is verified by complete distance. There are two uses.

``near_duplicates`` links 64-bit fingerprints (XXH64 of shingles of ``shingle`` words,
repeats included) that differ in at most ``distance`` bits. Of two such fingerprints
one of m segments differs in at most distance // m bits, so balls of that radius miss
nothing. Three segments make two million cells each; above ``MANY`` classes two make
four thousand million, with balls of radius 2.

``similar`` links texts whose sets of shingles have a Jaccard similarity of 0.8 or
more. SimHash estimates the angle between the sets: at 0.8, 15 % of all bits differ,
too many for balls that miss nothing. Fingerprints are longer there, and the number and
width of segments follow from the number of documents (``layout``), so that a cell
holds few unrelated texts and a pair at exactly 0.8 shares a ball of radius 1
with a probability of ``RECALL``; more similar pairs practically always do. Candidates
are verified by complete distance, and then by their exact sets.

Scale: equal fingerprints (equal sets) fold into one class before any search, by an
aggregate that combines before its shuffle. Links shrink to a spanning forest inside
each task before components are sought. ``near_duplicates`` shuffles fingerprints,
never texts. In ``similar`` a cell of many classes is mostly a group of near copies: its rows
are compared with the leaders of clusters, and no pair that would join what isn't
joined is passed over. The exact comparison of a component's members is cut into pieces
of bounded size. There, pairs that other links join already are passed over. Texts
are dealt once, if the candidates' ids are too many to send to every task.

Edge cases: null and empty texts have fingerprint zero and link like any other (in
``similar`` they have the empty set and are one class); texts shorter than a shingle
are one shingle; repeated rows each get a row. A null id takes part in no component
but its own (null); ``similar`` leaves such rows out, ``keep_one`` keeps them all.
An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_groups, pieces, settle, texts_of
from .graph import FOREST_NODES, Forest, components, merged, reduce_edges, smallest

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: (first bit, bits) of each segment; the second layout is for more than MANY classes.
SEGMENTS, WIDE_SEGMENTS, MANY = ((0, 22), (22, 21), (43, 21)), ((0, 32), (32, 32)), 16_000_000
#: Hashes summed up at once.
BATCH = 1 << 16
SIMILAR_SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.97
#: Bits by which a segment is shorter than the documents are many: a lookup meets about 2 ** SPARE unrelated texts, which
#: two words of fingerprint tell apart, and each bit less saves a tenth of the lookups that are dealt.
SPARE = 4
#: Classes in a cell up to which each lookup is compared with each of them at once, and rows of a cell that a task holds.
HOT, CELL_ROWS = 128, 50_000
#: Pairs of fingerprints compared at once.
BLOCK = 1 << 20
#: Lanes that go with a lookup; they decide what becomes a candidate.
SHIPPED = 2
#: Bytes of shingle sets, and classes, of one side of a piece of exact comparisons.
PIECE_BYTES, PIECE_ROWS = 16 << 20, 2048

#: The bits of a byte, each in a byte of its own: sums of up to 255 of them don't overflow.
_SPREAD = np.array([sum((b >> k & 1) << 8 * k for k in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, in order; a text of fewer words is one shingle."""
    # bytes.lower and bytes.split know ASCII only: exactly A-Z and \x20\x09-\x0D
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[len(ends) - n :].tolist())), np.uint64, n)


def _lane(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash made of a hash; the first is the hash itself."""
    if not k:
        return h
    x = h + np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    spread = _SPREAD[np.ascontiguousarray(h, "<u8").view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(spread, np.arange(0, len(h), 255), axis=0)
    return sums.astype("<u8").view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """64 bits for each lane, by majority; no hashes give zeros."""
    ones = np.zeros((lanes, 64), np.int64)
    for a in range(0, len(hashes), BATCH):
        for k in range(lanes):
            ones[k] += _ones(_lane(hashes[a : a + BATCH], k))
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches):
        for batch in pieces(batches, 1):
            fp = np.concatenate([fingerprint(shingle_hashes(t, shingle)) for t in texts_of(batch.column(1))]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame, distance: int = DISTANCE, segments=SEGMENTS) -> DataFrame:
    """Links (a, b) between different fingerprints of the column ``fp``; a pair can come more than once."""
    radius, fp = distance // len(segments), F.col("fp")
    if radius > 2:
        raise ValueError(f"{len(segments)} segments are for distances below {3 * len(segments)}")

    def cell(k: int, value, same: bool):
        return F.struct(F.lit(k).alias("seg"), value.cast("long").alias("cell"), F.lit(same).alias("same"))

    own, ball = [], []
    for k, (first, bits) in enumerate(segments):
        value = F.shiftrightunsigned(fp, first).bitwiseAND((1 << bits) - 1)
        own.append(cell(k, value, True))
        masks = [1 << b for b in range(bits)] if radius else []
        masks += [1 << b | 1 << c for b in range(bits) for c in range(b)] if radius > 1 else []
        # of two values that differ in a mask's bits, the one whose highest of them is 0 looks up the other
        ball += [F.when(value.bitwiseAND(1 << m.bit_length() - 1) == 0, cell(k, value.bitwiseXOR(F.lit(m)), False)) for m in masks]
    table = fps.select(fp.alias("b"), F.explode(F.array(*own)).alias("c")).select("b", "c.seg", "c.cell")
    probe = fps.select(fp.alias("a"), F.explode(F.array(*own, *ball)).alias("c")).where("c is not null").select("a", "c.*")
    near = f"bit_count(a ^ b) <= {distance} and (a < b or not same)"
    return probe.join(table, ["seg", "cell"]).where(near).select("a", "b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    fps = settle(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    classes = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    segments = SEGMENTS if classes.count() <= MANY else WIDE_SEGMENTS
    found = settle(reduce_edges(links(classes, distance, segments).selectExpr("a as u", "b as v")))
    # components are over fingerprints; the answer is the smallest document of all of them
    answer = smallest(classes.selectExpr("fp as node", "rep"), components(found))
    out = fps.join(answer, F.col("fp") == F.col("node"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("smallest")).alias("component_id"))


def layout(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int, int, int, int]:
    """For n documents: bits of a segment, number of segments, lanes, and the most differing bits of the shipped lanes and of all."""
    # sets of one size with Jaccard similarity j have the cosine 2 j / (1 + j); a bit differs with angle / pi
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = min(32, max(8, math.ceil(math.log2(max(n, 2))) - SPARE))
    ball = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    count = max(1, math.ceil(math.log(1 - recall) / math.log(1 - ball)))
    lanes = max(SHIPPED, math.ceil(bits * count / 64))
    most = lambda size, wide: math.floor(size * p + wide * math.sqrt(size * p * (1 - p)))
    return bits, count, lanes, most(64 * SHIPPED, 3), most(64 * lanes, 4)


def _key(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")


def _sketches(texts: DataFrame, shingle: int, lanes: int) -> DataFrame:
    """(doc_id, key, fp): the set's hash and its fingerprint."""

    def run(batches):
        for batch in pieces(batches, 1):
            own = [np.unique(shingle_hashes(t, shingle)) for t in texts_of(batch.column(1))]
            fps = np.concatenate([fingerprint(s, lanes) for s in own]).view(np.int64)
            offsets = pa.array(np.arange(len(own) + 1, dtype=np.int32) * lanes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array([_key(s) for s in own], np.uint64).view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(fps))], names=["doc_id", "key", "fp"])

    return texts.mapInArrow(run, "doc_id long, key long, fp array<long>")


def _fps(column: pa.Array, lanes: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, lanes)


def _segment(fps: np.ndarray, first: int, bits: int) -> np.ndarray:
    """Bits first to first + bits - 1 of fingerprints of several lanes."""
    k, at = divmod(first, 64)
    value = fps[:, k] >> np.uint64(at)
    if at + bits > 64:
        value = value | fps[:, k + 1] << np.uint64(64 - at)
    return value & np.uint64((1 << bits) - 1)


def _entries(classes: DataFrame, bits: int, count: int, lanes: int) -> DataFrame:
    """(cell, probe, key, lanes): each class under its segments' values, and its lookups of the values one bit higher; with its first ``SHIPPED`` lanes."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, fps = batch.column(0).to_numpy(), _fps(batch.column(1), lanes)
            for k in range(count):
                value = _segment(fps, k * bits, bits)
                cells, rows = [value], [np.arange(len(value))]
                for b in range(bits):
                    at = np.flatnonzero(value & np.uint64(1 << b) == 0)
                    cells.append(value[at] | np.uint64(1 << b))
                    rows.append(at)
                cell, row = np.concatenate(cells) | np.uint64(k << bits), np.concatenate(rows)
                probe = np.ones(len(cell), np.int8)
                probe[: len(value)] = 0
                shipped = [pa.array(fps[row, x].view(np.int64)) for x in range(SHIPPED)]
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(probe), pa.array(keys[row]), *shipped], names=names)

    names = ["cell", "probe", "key", *(f"lane{x}" for x in range(SHIPPED))]
    return classes.select("key", "fp").mapInArrow(run, ", ".join(f"{x} {'byte' if x == 'probe' else 'long'}" for x in names))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of lanes, which broadcast."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _near_links(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that join the same rows of lanes as all pairs do that differ in at most ``most`` bits.

    Equal ones are one. A row not yet near a leader becomes one, and those near it its cluster; clusters
    are then joined where two of their rows are near, which needs a look only where their
    leaders aren't further apart than ``most`` and what both clusters extend to. A group
    of near copies has few leaders, so it costs as much as it has rows.
    """
    _, first, of = np.unique(fps, axis=0, return_index=True, return_inverse=True)
    of = of.ravel()
    links = [(i, int(first[of[i]])) for i in np.flatnonzero(first[of] != np.arange(len(of))).tolist()]
    left, clusters, extent = np.sort(first), [], []
    while len(left):
        far = _apart(fps[left], fps[left[0]])
        near = far <= most
        clusters.append(left[near])
        extent.append(int(far[near].max()))
        links += [(i, int(left[0])) for i in left[near][1:].tolist()]
        left = left[~near]
    extent, leads, joined = np.array(extent), fps[[c[0] for c in clusters]], Forest()
    for a in np.flatnonzero(extent).tolist():
        reach = np.flatnonzero(_apart(leads, leads[a]) <= most + extent[a] + extent)
        for b in reach[(reach != a) & ((extent[reach] == 0) | (reach > a))].tolist():
            if joined.find(a) != joined.find(b):
                one, two = clusters[a], clusters[b]
                rows = max(1, BLOCK // len(two))
                for k in range(0, len(one), rows):
                    hit = np.argwhere(_apart(fps[one[k : k + rows], None], fps[None, two]) <= most)
                    if len(hit):
                        links.append((int(one[k + hit[0][0]]), int(two[hit[0][1]])))
                        joined.link(a, b)
                        break
    return links


def _candidates(entries: DataFrame, most: int) -> DataFrame:
    """A spanning forest (u, v) of the pairs that some lookup fetches and whose first ``SHIPPED`` lanes differ in at most ``most`` bits.

    A cell of many classes is compared by ``_near_links``; one of more than ``CELL_ROWS`` rows
    leaves its task as it is, and is compared in pieces of pairs of its parts.
    """
    names = ["u", "v", "cell", "key", "fp"]
    types = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def out(u=None, v=None, cell=None, key=None, lanes=None) -> pa.RecordBatch:
        n = len(u if cell is None else cell)
        fp = None if lanes is None else pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * SHIPPED), pa.array(np.column_stack(lanes).ravel()))
        columns = (u, v, None if cell is None else pa.array(cell), None if key is None else pa.array(key), fp)
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else c for c, t in zip(columns, types)], names=names)

    def compared(forest: Forest, cell, probe, key, *lanes) -> None:
        """Links the pairs of whole cells, whose rows come in order of cell and probe."""
        table = np.flatnonzero(probe == 0)
        if not len(table):
            return
        cells, first, n = np.unique(cell[table], return_index=True, return_counts=True)
        of = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
        asks = np.flatnonzero((cells[of] == cell) & (n[of] <= HOT))
        size = n[of[asks]]
        row = np.repeat(asks, size)
        step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        other = table[first[of[row]] + step]
        good = other < row
        i, j = row[good], other[good]
        near = sum(np.bitwise_count((x[i] ^ x[j]).view(np.uint64)).astype(np.int64) for x in lanes) <= most
        for u, v in zip(key[i[near]].tolist(), key[j[near]].tolist()):
            forest.link(u, v)
        for hot in cells[n > HOT].tolist():
            a, b = np.searchsorted(cell, [hot, hot + 1])
            own = key[a:b]
            for i, j in _near_links(np.column_stack([x[a:b] for x in lanes]).view(np.uint64), most):
                forest.link(int(own[i]), int(own[j]))

    def run(batches):
        forest, large = Forest(), None
        held = [np.zeros(0, np.int64), np.zeros(0, np.int8), *(np.zeros(0, np.int64) for _ in range(1 + SHIPPED))]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.concatenate(x) for x in zip(held, (c.to_numpy(zero_copy_only=False) for c in batch.columns))]
            cell = rows[0]
            last = int(np.searchsorted(cell, cell[-1]))
            start = int(np.searchsorted(cell, large, "right")) if large is not None else 0
            if start:
                yield out(cell=cell[:start], key=rows[2][:start], lanes=[x[:start] for x in rows[3:]])
            if last > start:
                compared(forest, *(x[start:last] for x in rows))
            held = [x[max(start, last) :] for x in rows]
            if len(held[0]) > CELL_ROWS:
                large = int(cell[-1])
                yield out(cell=held[0], key=held[2], lanes=held[3:])
                held = [x[:0] for x in held]
            if len(forest.parent) > FOREST_NODES:
                for packed in forest.packed():
                    yield out(packed.column(0), packed.column(1))
                forest = Forest()
        compared(forest, *held)
        for packed in forest.packed():
            yield out(packed.column(0), packed.column(1))

    def piece(group: pa.Table) -> pa.RecordBatch | None:
        key = group.column("key").to_numpy()
        found = _near_links(_fps(group.column("fp").combine_chunks(), SHIPPED), most)
        return pa.RecordBatch.from_arrays([pa.array(key[[x[side] for x in found]]) for side in (0, 1)], names=["u", "v"]) if found else None

    dealt = entries.repartition("cell").sortWithinPartitions("cell", "probe", "key")
    done = settle(dealt.mapInArrow(run, "u array<long>, v array<long>, cell long, key long, fp array<long>"))
    forests = merged(done.where("u is not null").select("u", "v"))
    rest = done.where("u is null").select("cell", "key", "fp")
    if rest.isEmpty():
        return forests
    sized = settle(rest.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("chunks")))
    placed = rest.join(sized, "cell").withColumn("c", F.pmod(F.xxhash64(F.lit(SEED), "key"), F.col("chunks")).cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = placed.select("key", "fp", F.xxhash64("cell", F.least("c", "d"), F.greatest("c", "d")).alias("piece"))
    return forests.unionByName(map_groups(placed, "piece", piece, "u long, v long"))


def _sets(texts: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """(key, own): the sets of the classes (key, rep)."""

    def run(batches):
        for batch in pieces(batches, 1):
            own = [np.unique(shingle_hashes(t, shingle)) for t in texts_of(batch.column(1))]
            offsets = np.cumsum([0, *map(len, own)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_key(s) for s in own], np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own).view(np.int64)))], names=["key", "own"])

    ids = needed.select(F.col("rep").alias("doc_id")).distinct()
    sets = texts.join(ids, "doc_id", "left_semi").mapInArrow(run, "key long, own array<long>")
    # an id that repeats brings texts that aren't asked for
    return sets.join(needed.select("key"), "key", "left_semi").groupBy("key").agg(F.any_value("own").alias("own"))


def _confirmed(members: DataFrame, lanes: int, most: int, similarity: float) -> DataFrame:
    """A spanning forest (u, v) of the links among (key, component, fp, own)."""
    sized = members.groupBy("component").agg(F.sum(8 * F.size("own")).alias("bytes"), F.count("*").alias("n"))
    cut = sized.select("component", F.ceil(F.greatest(F.col("bytes") / PIECE_BYTES, F.col("n") / PIECE_ROWS)).cast("int").alias("chunks")).where("chunks > 1")
    placed = members.join(settle(cut), "component", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    placed = placed.withColumn("c", F.pmod(F.xxhash64(F.lit(SEED), "key"), F.col("chunks")).cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = placed.select("key", "fp", "own", "c", "d", F.xxhash64("component", F.least("c", "d"), F.greatest("c", "d")).alias("piece"))

    def work(group: pa.Table) -> pa.RecordBatch | None:
        n = group.num_rows
        if n < 2:
            return None
        keys, fps = group.column("key").to_numpy(), _fps(group.column("fp").combine_chunks(), lanes)
        flat = group.column("own").combine_chunks()
        at, values = flat.offsets.to_numpy(), flat.values.to_numpy(zero_copy_only=False).view(np.uint64)
        size = np.diff(at)
        left, right = (np.flatnonzero(x) for x in ((group.column("c").to_numpy() <= group.column("d").to_numpy()), (group.column("c").to_numpy() >= group.column("d").to_numpy())))
        part = np.arange(n)  # the part of each row, joined as links are found
        found = []
        for i in left.tolist():
            other = right[part[right] != part[i]]
            other = other[np.bitwise_count(fps[other] ^ fps[i]).sum(axis=1, dtype=np.int64) <= most]
            low, high = np.minimum(size[other], size[i]), np.maximum(size[other], size[i])
            for j in other[low >= similarity * high - 1e-9].tolist():
                if part[i] != part[j]:
                    common = len(np.intersect1d(values[at[i] : at[i + 1]], values[at[j] : at[j + 1]], assume_unique=True))
                    # rounding aside, common / (size i + size j - common) >= similarity
                    if common >= similarity * (size[i] + size[j] - common) - 1e-9:
                        part[part == part[j]] = part[i]
                        found.append((keys[i], keys[j]))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["u", "v"]) if found else None

    return map_groups(placed, "piece", work, "u long, v long")


def similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per document with an id: doc_id, component_id (the smallest id of its group)."""
    texts = _texts(docs, id_col, text_col)
    bits, count, lanes, of_shipped, of_all = layout(texts.count(), similarity, recall)
    rows = settle(_sketches(texts, shingle, lanes))
    classes = settle(rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.any_value("fp").alias("fp")))
    groups = components(settle(_candidates(_entries(classes, bits, count, lanes), of_shipped)))
    # components() leaves out the smallest node of each
    groups = settle(groups.union(groups.select("component", "component").distinct()))
    needed = settle(classes.join(groups.withColumnRenamed("node", "key"), "key"))
    members = settle(needed.drop("rep").join(_sets(texts, needed.select("key", "rep"), shingle), "key"))
    edges = settle(_confirmed(members, lanes, of_all, similarity))
    answer = smallest(classes.select(F.col("key").alias("node"), "rep"), components(edges))
    return rows.select("doc_id", "key").join(answer, F.col("key") == F.col("node")).select("doc_id", F.col("smallest").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of ``similar``: that of the smallest id.

    Rows that repeat an id and a text are one (the least in the other columns stays);
    only rows of repeated ids are dealt for that. Rows without an id all stay.
    """
    found = settle(similar(docs, id_col=id_col, text_col=text_col, **options))
    columns, own = docs.columns, f"{id_col}_of_found"
    while own in columns:
        own += "_"
    drop = found.where("component_id <> doc_id").select(F.col("doc_id").alias(own)).distinct()
    kept = docs.join(drop, F.col(id_col).cast("long") == F.col(own), "left_anti")
    repeated = settle(found.groupBy(F.col("doc_id").alias(own)).count().where("count > 1").select(own))
    if repeated.isEmpty():
        return kept
    again = F.col(id_col).cast("long") == F.col(own)
    others = [F.col(f.name) for f in docs.schema.fields if f.name not in (id_col, text_col) and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    least = kept.join(repeated, again, "left_semi").groupBy(id_col, text_col).agg(F.min_by(F.struct(*columns), F.struct(F.lit(0), *others)).alias(own)).select(f"{own}.*")
    return kept.join(repeated, again, "left_anti").unionByName(least)
