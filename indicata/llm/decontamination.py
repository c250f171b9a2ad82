"""Benchmark decontamination by Wu-Manber search over words.

Every run of ``window`` consecutive words of a benchmark item is a pattern; an
item of fewer words, but at least one, is one pattern. All patterns of one length
make one Wu-Manber searcher whose symbols are words:

* a *block* is the hash of two consecutive words (one, for patterns of one word);
* the *shift table* gives, for a block, how far the search may move on. A block
  that no pattern holds allows the largest shift, so only every ``span``-th block
  of a text is looked at, and only around known blocks are the others;
* blocks that end a pattern have shift 0 and lead to a *bucket* keyed by the
  suffix block and the prefix block, and
* the window's words are compared directly with the patterns of the bucket.

Scale: texts are searched where they lie. The patterns go to the executors in blocks of
``block_words`` item words (some 250 MB in a Python worker, which keeps one block's
tables for all its tasks); more blocks mean more passes, so memory doesn't grow with the
benchmark. One block needs no shuffle. Of several, each pass gives out only what it found,
keyed by two hashes of the text, as equal texts have equal findings; these are joined to
the documents' ids, and where documents are to be removed, once to the documents.

Edge cases: null or empty texts have no words and are clean; an item without
words, or with a null id, never matches; an item id that repeats counts once;
repeated documents each get their row; an empty benchmark leaves all clean.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, pieces, settle, slices, texts_of

WINDOW = 10
#: Item words in one broadcast block of patterns.
BLOCK_WORDS = 600_000


class Searcher:
    """Wu-Manber tables for patterns of one length in words."""

    def __init__(self, length: int, patterns: dict[bytes, Sequence[str]]):
        self.length, self.patterns = length, patterns
        self.block = min(2, length)
        self.span = length - self.block + 1
        words = Words(list(patterns))
        h = words.hashes().reshape(len(patterns), length)
        blocks = h if self.block == 1 else mix(h[:, :-1], h[:, 1:])
        keys, shift = blocks.ravel(), np.tile(np.arange(self.span - 1, -1, -1), len(patterns))
        order = np.lexsort((shift, keys))
        self.keys, first = np.unique(keys[order], return_index=True)
        self.shift = shift[order][first]
        self.buckets = np.unique(mix(blocks[:, -1], blocks[:, 0]))

    def _shifts(self, words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block hash and shift at each position, which is that of a block's last word."""
        h = words.hashes(at)
        if self.block == 2:
            h = mix(words.hashes(at - 1), h)
        k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return h, np.where(self.keys[k] == h, self.shift[k], self.span)

    def find(self, words: Words) -> Iterator[tuple[int, Sequence[str]]]:
        """The first word and the items of every occurrence in the buffer; it may cross texts."""
        n = len(words.starts)
        if n < self.length:
            return
        at = np.arange(self.length - 1, n + self.span - 1, self.span)
        at[-1] = min(at[-1], n - 1)
        _, shift = self._shifts(words, at)
        near = shift < self.span
        ends = (at[near] + shift[near])[:, None] + np.arange(self.span)
        ends = ends[(ends < n) & (ends < at[near][:, None] + self.span)]
        ends = np.unique(ends[ends >= self.length - 1])
        if not len(ends):
            return
        suffix, shift = self._shifts(words, ends)
        ends, suffix = ends[shift == 0], suffix[shift == 0]
        if not len(ends):
            return
        start = ends - self.length + 1
        prefix = words.hashes(start)
        if self.block == 2:
            prefix = mix(prefix, words.hashes(start + 1))
        key = mix(suffix, prefix)
        k = np.minimum(np.searchsorted(self.buckets, key), len(self.buckets) - 1)
        for i in start[self.buckets[k] == key].tolist():
            items = self.patterns.get(words.phrase(i, i + self.length))
            if items:
                yield i, items


def searchers(items: list[tuple[str, bytes]], window: int) -> list[Searcher]:
    by_length: dict[int, dict[bytes, Sequence[str]]] = defaultdict(dict)
    for item_id, text in items:
        words, own = Words([text]), (item_id,)  # one tuple for all windows that only this item has
        n = len(words.starts)
        if n:
            length = min(n, window)
            known = by_length[length]
            for i in range(n - length + 1):
                had = known.setdefault(words.phrase(i, i + length), own)
                if had[-1] != item_id:
                    if isinstance(had, tuple):
                        known[words.phrase(i, i + length)] = [*had, item_id]
                    else:
                        had.append(item_id)
    return [Searcher(k, v) for k, v in sorted(by_length.items())]


_BUILT: dict[tuple[str, int], list[Searcher]] = {}


def _built(patterns, window: int) -> list[Searcher]:
    """The searchers of a broadcast block, kept by this worker until it gets another block."""
    if (patterns.id, window) not in _BUILT:
        _BUILT.clear()
        _BUILT[patterns.id, window] = searchers(patterns.value, window)
    return _BUILT[patterns.id, window]


def _search(found: list[Searcher], texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, set[str]]]:
    """Per text: number of words, hit flag of each word, items found."""
    for a, b in slices([len(t) for t in texts]):
        words = Words(texts[a:b])
        bounds = words.first
        marks = np.zeros(len(words.starts) + 1, np.int32)
        items: dict[int, set[str]] = defaultdict(set)
        for s in found:
            for i, ids in s.find(words):
                doc = int(np.searchsorted(bounds, i, "right")) - 1
                if i + s.length <= bounds[doc + 1]:
                    marks[i] += 1
                    marks[i + s.length] -= 1
                    items[doc].update(ids)
        hit = np.cumsum(marks[:-1]) > 0
        for k in range(b - a):
            yield int(bounds[k + 1] - bounds[k]), hit[bounds[k] : bounds[k + 1]], items.get(k, set())


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark, a bounded block at a time; the driver holds one block."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null")
    for r in rows.toLocalIterator():
        text = r["t"].encode()
        n = len(text) // 2 + 1
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r["i"], text))
        size += n
    yield block


class _Block:
    """A broadcast block of items, and its number."""

    def __init__(self, df: DataFrame, number: int, block: list[tuple[str, bytes]]):
        self._sent = df.sparkSession.sparkContext.broadcast(block)
        self.id = f"{number}-{uuid.uuid4().hex}"

    @property
    def value(self):
        return self._sent.value


def _rows(ids: pa.Array, n: list[int], hits: list[np.ndarray], items: list[set[str]]) -> pa.RecordBatch:
    hit = [int(h.sum()) for h in hits]
    digests = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())], names=REPORT)


REPORT = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
#: Two hashes of a text.
KEY = ["h", "g"]


def _keyed(docs: DataFrame, text_col: str) -> list:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("h"), F.xxhash64(F.lit("second"), text).alias("g")]


def _findings(docs: DataFrame, blocks: list[_Block], text_col: str, window: int) -> DataFrame:
    """(h, g, block, bits, items) of each text in which a block's items occur; bits has one bit for each of its words."""
    texts = docs.select(*_keyed(docs, text_col), F.col(text_col).cast("string").alias("t"))

    def search(block: _Block):
        def run(batches):
            for batch in pieces(batches, 2):
                rows = [(k, np.packbits(hit).tobytes(), sorted(ids)) for k, (_, hit, ids) in enumerate(_search(_built(block, window), texts_of(batch.column(2)))) if ids]
                at = pa.array([k for k, _, _ in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([b for _, b, _ in rows], pa.binary()), pa.array([i for _, _, i in rows], pa.list_(pa.string()))], names=["h", "g", "bits", "items"])

        return texts.mapInArrow(run, "h long, g long, bits binary, items array<string>")

    found = reduce(DataFrame.union, [search(b).withColumn("block", F.lit(k)) for k, b in enumerate(blocks)])
    # equal texts have equal findings
    return found.groupBy("h", "g", "block").agg(F.any_value("bits").alias("bits"), F.any_value("items").alias("items"))


def _blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, block_words: int) -> list[_Block]:
    return [_Block(docs, k, b) for k, b in enumerate(_item_blocks(benchmark, item_col, item_text_col, block_words))]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: counts of its words, hit words and items, the items' digest, and the verdict."""
    blocks = _blocks(docs, benchmark, item_col, item_text_col, block_words)
    kind = docs.select(F.col(id_col).alias("i")).schema["i"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    if len(blocks) == 1:

        def run(batches):
            for batch in pieces(batches, 1):
                n, hits, items = zip(*_search(_built(blocks[0], window), texts_of(batch.column(1))))
                yield _rows(batch.column(0), n, hits, items)

        return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)

    def count(batches):
        for batch in pieces(batches, 1):
            words = Words(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(words.first)), batch.column(2), batch.column(3)], names=["i", "n", *KEY])

    def join(batches):
        for batch in batches:
            if batch.num_rows:
                hits, items = [], []
                for n, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    bits = [np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=n) for x in found or ()]
                    hits.append(reduce(np.bitwise_or, bits, np.zeros(n, np.uint8)))
                    items.append({i for x in found or () for i in x["items"]})
                yield _rows(batch.column(0), batch.column(1).to_pylist(), hits, items)

    counted = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), *_keyed(docs, text_col)).mapInArrow(count, f"i {kind}, n long, h long, g long")
    # one entry for each block at most
    found = _findings(docs, blocks, text_col, window).groupBy(*KEY).agg(F.collect_list(F.struct("bits", "items")).alias("found"))
    return counted.join(settle(found), KEY, "left").select("i", "n", "found").mapInArrow(join, schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without those that hold a window of the benchmark; no shuffle if the benchmark is one block."""
    blocks = _blocks(docs, benchmark, item_col, item_text_col, block_words)
    if len(blocks) == 1:

        def run(batches):
            for batch in pieces(batches, text_col):
                texts = texts_of(batch.column(batch.schema.get_field_index(text_col)))
                yield batch.filter(pa.array([not ids for _, _, ids in _search(_built(blocks[0], window), texts)]))

        return docs.mapInArrow(run, docs.schema)
    bad = settle(_findings(docs, blocks, text_col, window).select(*KEY).distinct())
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.join(bad, (F.xxhash64(text) == bad["h"]) & (F.xxhash64(F.lit("second"), text) == bad["g"]), "left_anti")
