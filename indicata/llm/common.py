"""Shared plumbing: checkpoints, Arrow mapping and vectorised word spans."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at once inside a worker; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share.

    It is the one that ``spark.checkpoint.dir`` names, or the checkpoint folder the
    session has. Only a session in a single process (local tests) gets one of its own;
    on a cluster without either this fails, as a machine's own folder would lose rows.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/indicata-checkpoints-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterable[pa.RecordBatch], text: int | str) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in batches of ``SLICE_BYTES`` of text at most (or of one row); never an empty one.

    What a worker holds for a batch - texts, words, results - then stays a small
    multiple of that, whatever the size of the batches that Spark sends.
    """
    for batch in batches:
        if batch.num_rows:
            column = batch.column(batch.schema.get_field_index(text) if isinstance(text, str) else text)
            for a, b in slices(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                yield batch.slice(a, b - a)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes add up to ``limit`` at most, or of one row."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def ascii_word_lut() -> np.ndarray:
    """Byte table for words over 0-9, a-z and all of non-ASCII: lower-cased byte, or 0 for a separator."""
    lut = np.zeros(256, np.uint8)
    lut[0x80:] = np.arange(0x80, 0x100)
    for low, high in ((0x30, 0x39), (0x61, 0x7A)):
        lut[low : high + 1] = np.arange(low, high + 1)
    lut[0x41:0x5B] = np.arange(0x61, 0x7B)
    return lut


_LUT = ascii_word_lut()
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(29)
_KEEP = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 8)] + [(1 << 64) - 1], np.uint64)


class Words:
    """Words of several texts as byte spans of one lower-cased buffer.

    ``first[i]:first[i + 1]`` are the words of text ``i``; ``starts`` and ``ends``
    are offsets into ``low``. Memory is a small multiple of the texts' bytes.
    """

    def __init__(self, texts: list[bytes]):
        raw = b"\n".join(texts)
        self.low = np.concatenate([_LUT[np.frombuffer(raw, np.uint8)], np.zeros(16, np.uint8)])
        word = self.low != 0
        edge = np.flatnonzero(np.diff(word, prepend=False))
        self.starts, self.ends = edge[0::2], edge[1::2]
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.starts, offsets)
        self.data = self.low.tobytes()

    def hashes(self, at: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of those at the given indices."""
        s, e = (self.starts, self.ends) if at is None else (self.starts[at], self.ends[at])
        lanes = as_strided(self.low.view(np.uint8), shape=(len(self.low) - 7, 8), strides=(1, 1))
        h = (e - s).astype(np.uint64) * _MUL2
        live, pos = np.arange(len(s)), s.copy()
        while len(live):
            left = np.minimum(e[live] - pos, 8)
            lane = np.ascontiguousarray(lanes[pos]).view(np.uint64).ravel() & _KEEP[left]
            x = (h[live] ^ lane) * _MUL
            h[live] = (x ^ (x >> _SHIFT)) * _MUL2
            more = e[live] - pos > 8
            live, pos = live[more], pos[more] + 8
        return h

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]

    def phrase(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by one space."""
        return b" ".join([self.data[a:b] for a, b in zip(self.starts[i:j].tolist(), self.ends[i:j].tolist())])


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes, in that order."""
    x = (a * _MUL) ^ (b + _MUL2)
    x = (x ^ (x >> _SHIFT)) * _MUL2
    return x ^ (x >> _SHIFT)


def map_groups(df: DataFrame, group: str, fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Runs ``fn`` on the rows of each value of the long column ``group``.

    Rows are dealt by the value and sorted, and groups stream through a worker one
    after another, so many small groups cost little. Callers bound a group's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(batch.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if open_rows and open_rows[0].column(batch.schema.get_field_index(group))[0].as_py() != ids[a]:
                    if (out := fn(pa.Table.from_batches(open_rows))) is not None:
                        yield out
                    open_rows = []
                open_rows.append(batch.slice(a, b - a))
        if open_rows and (out := fn(pa.Table.from_batches(open_rows))) is not None:
            yield out

    return df.repartition(group).sortWithinPartitions(group).mapInArrow(run, schema)


def map_whole_groups(df: DataFrame, group: str, fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str, order: Sequence[str] = ()) -> DataFrame:
    """As ``map_groups``, but ``fn`` gets many groups at once, sorted by ``group`` and then ``order``, each of them whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(batch.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(ids, ids[-1]))
            if held and (last or held[-1].column(batch.schema.get_field_index(group))[0].as_py() != ids[0]):
                if (out := fn(pa.Table.from_batches([*held, batch.slice(0, last)]))) is not None:
                    yield out
                held = []
            elif last and (out := fn(pa.Table.from_batches([batch.slice(0, last)]))) is not None:
                yield out
            held.append(batch.slice(last))
        if held and (out := fn(pa.Table.from_batches(held))) is not None:
            yield out

    return df.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)


def matrix(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1)
