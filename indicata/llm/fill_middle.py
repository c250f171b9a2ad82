"""Fill-in-the-middle transformation over an index of distinct texts.

Identical texts form a group, whose Elias-Fano list of code point boundaries is made
once and serves all its documents. A document's seeded hashes choose two
cuts among the boundaries; each is one select in the list. The parts are then put in the
order of the document's form: ``plain`` (the text), ``psm`` (prefix, suffix, middle) or
``spm`` (suffix, prefix, middle), with a marker before each.

Groups are keyed by two 64-bit hashes and the length, and verified by content: the SHA-256 of each
document's own text goes along with its id, and is held against that of its group's text. Should
they ever differ, the job fails with a message; it never gives a document another one's text.

Scale: texts are dealt once, by key, after copies within a task are folded into one
(an aggregate's partial step); documents join their group by narrow rows of id and key. A
group of more than ``HOT`` documents, which would land in one task, is cut into pieces of about
``HOT``: its text goes along once for each piece, so that adds at most one text in
``HOT`` of the input. Within a task, rows of a text are adjacent, and the list of the last text
is kept. No list of documents is ever gathered.

Edge cases: a null text is empty, and empty texts are plain; so are texts that hold a marker, as
they couldn't be restored. A null id is hashed like an empty one. Repeated rows are
each transformed, alike. Code points count, not bytes or graphemes. An empty table has no
rows. Other columns of the table are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, settle

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = "1"
#: Of 100: documents that stay plain are those from this on, and of the others those below SPM_SHARE are spm.
PLAIN_FROM, SPM_SHARE = 90, 20
#: Documents of one text in a task, about.
HOT = 4096
#: Bits of a block whose ones are counted ahead for a select.
BLOCK = 512
TYPES = {"long": pa.int64(), "string": pa.string()}


class Boundaries:
    """The byte offsets at which code points of a UTF-8 text start, and its end, as an Elias-Fano list.

    Each of the ``n`` + 1 offsets is cut into ``low`` low bits, stored as they are, and the rest, stored in unary:
    bit (offset >> low) + k of ``high`` is set for the k-th. Ones are counted ahead for each block of
    ``BLOCK`` bits, so a select reads one block.
    """

    def __init__(self, text: bytes):
        raw = np.frombuffer(text, np.uint8)
        at = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw)).astype(np.int64)
        self.n = len(at) - 1
        self.low = max(0, (max(1, len(raw)) // len(at)).bit_length() - 1)
        ones = (at >> self.low) + np.arange(len(at))
        size = -(-(int(ones[-1]) + 1) // BLOCK) * BLOCK
        bits = np.zeros(size, np.uint8)
        bits[ones] = 1
        self.high = np.packbits(bits, bitorder="little")
        low = at[:, None] >> np.arange(self.low) & 1
        self.lows = np.packbits(low.astype(np.uint8).ravel(), bitorder="little")
        self.ahead = np.concatenate([[0], np.cumsum(bits.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64))])

    def select(self, k: int) -> int:
        """The k-th offset, from 0 to ``n``."""
        block = int(np.searchsorted(self.ahead, k, "right")) - 1
        own = np.unpackbits(self.high[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        one = block * BLOCK + int(np.flatnonzero(own)[k - int(self.ahead[block])])
        first = k * self.low
        part = np.unpackbits(self.lows[first // 8 : (first + self.low + 7) // 8], bitorder="little")[first % 8 : first % 8 + self.low]
        return (one - k << self.low) + int((part.astype(np.int64) << np.arange(self.low)).sum())


def cuts(n: int, key: str, seed: str = SEED) -> tuple[int, int, str]:
    """Code points before the middle and before the suffix, and the form, of a text of ``n`` that holds no marker."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    form = "plain" if not n or h[2] % 100 >= PLAIN_FROM else "spm" if h[3] % 100 < SPM_SHARE else "psm"
    return a, b, form


def transform(text: bytes, index: Boundaries, key: str, seed: str = SEED) -> tuple[str, int | None, int | None, bytes]:
    """Form, code points of prefix and middle, and the output."""
    a, b, form = cuts(index.n, key, seed)
    if form == "plain" or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", None, None, text
    i, j = index.select(a), index.select(b)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    out = (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle) if form == "psm" else (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    return form, a, b - a, b"".join(out)


def restore(output: bytes, form: str) -> bytes:
    """The text that an output of that form was made of."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    head, _, middle = output[len(PREFIX) :].partition(MIDDLE)
    one, _, two = head.partition(second)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _paired(docs: DataFrame, id_col: str, text_col: str, hot: int) -> DataFrame:
    """(doc_id, text, sha): each document with its group's text and the digest of its own, the documents of a text one after another."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    every = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.xxhash64(F.lit(7), text).alias("second"), F.octet_length(text).alias("bytes"))
    key = ["hash", "second", "bytes"]
    ids = every.select("doc_id", *key, F.unhex(F.sha2("text", 256)).alias("sha"))
    large = settle(ids.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > hot).select(*key, F.ceil(F.col("n") / hot).cast("int").alias("parts")))
    groups = every.groupBy(*key).agg(F.min("text").alias("text"))
    few = ids.join(large, key, "left_anti").join(groups.hint("merge"), key).select("doc_id", "text", "sha")
    # an id can repeat as often as a text does, so rows are salted by where they lie as well
    salted = ids.withColumn("salt", F.monotonically_increasing_id()).join(large, key)
    salted = salted.select("doc_id", *key, "sha", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "salt"), F.col("parts")).cast("int").alias("part"))
    texts = groups.join(large, key).select(*key, "text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return few.unionByName(salted.join(texts.hint("merge"), [*key, "part"]).select("doc_id", "text", "sha"))


def _mapped(docs: DataFrame, schema: str, row, *, id_col: str, text_col: str, hot: int) -> DataFrame:
    paired = _paired(docs, id_col, text_col, hot).withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    kind = paired.schema["doc_id"].dataType.simpleString()
    names, types = zip(("doc_id", None), *((c.split()[0], TYPES[c.split()[1]]) for c in schema.split(", ")))
    types = types[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index, digest = None, None, None
        for batch in pieces(batches, 1):
            out = []
            for text, own, key in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if text != last:
                    last, index, digest = text, Boundaries(text), hashlib.sha256(text).digest()
                if own != digest:
                    raise ValueError("two texts have the same length and the same 128 bits of hash")
                out.append(row(text, index, key))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*out), types)], names=names)

    return paired.mapInArrow(run, f"doc_id {kind}, {schema}")


def transformed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output (the transformed text)."""

    def row(text: bytes, index: Boundaries, key: str) -> tuple:
        form, prefix, middle, output = transform(text, index, key)
        return index.n, form, prefix, middle, output.decode()

    return _mapped(docs, "n long, form string, prefix_chars long, middle_chars long, output string", row, id_col=id_col, text_col=text_col, hot=hot)


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""

    def row(text: bytes, index: Boundaries, key: str) -> tuple:
        form, prefix, middle, output = transform(text, index, key)
        return index.n, form, prefix, middle, hashlib.sha256(output).hexdigest(), hashlib.sha256(restore(output, form)).hexdigest()

    return _mapped(docs, "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string", row, id_col=id_col, text_col=text_col, hot=hot)


ORACLE_SQL = f"""
with own as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) as d from documents
), hashed as (
  select doc_id, t, n, ('0x' || substr(d, 1, 8))::bigint as h1, ('0x' || substr(d, 9, 8))::bigint as h2, ('0x' || substr(d, 17, 8))::bigint as h3, ('0x' || substr(d, 25, 8))::bigint as h4 from own
), cut as (
  select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= {PLAIN_FROM} then 'plain' when h4 % 100 < {SPM_SHARE} then 'spm' else 'psm' end as form
  from hashed
), parts as (
  select *, substring(t, 1, a) as p, substring(t, a + 1, b - a) as m, substring(t, b + 1, n - b) as s from cut
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then a end::bigint as prefix_chars, case when form <> 'plain' then b - a end::bigint as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from parts
"""
