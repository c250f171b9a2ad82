"""Secret scans: base patterns, and random strings by token efficiency.

Base kinds are an assignment to a name like ``password``, an access key and a long
run of hex digits. Beyond them, a run of key-like characters is random if a BPE
vocabulary spells it with few characters per token: words and names compress well,
random strings don't. Known digests (a run of hex digits as long as one of the usual
digests), UUIDs, numbers, dates and identifiers (words joined by case, ``_``, ``-`` or ``/``)
are excluded first, and so is what a base span already covers. Identifiers are
excluded only where their long words compress like words. The vocabulary is one of many languages,
and what could be a word must be spelt worse than other runs to be random. Runs of fewer than
``shortest`` characters say too little to judge and are left to the base kinds.

Scale: one pass, no shuffle; a document without any key-like run costs a few
searches. The vocabulary (a fixed size) goes to the executors once. Time is linear in
a text's length: expressions don't backtrack, spans are swept once, and the tokens of a
run are counted in steps of ``STEP`` characters.

Edge cases: null and empty texts have no spans; offsets count code points; texts are
read whole; equal spans of different kinds are all listed. Repeated rows are each
scanned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import rank_file, read_ranks
from .common import pieces, texts_of

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters of a run that is judged, at least.
SHORTEST = 20
#: A long word of an identifier.
WORD = re.compile(r"[A-Za-z]{12,}")
DIGITS = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Characters per token below which a run is random; and one that could be a word, which takes more to be none.
EFFICIENCY, WORD_EFFICIENCY = 2.2, 2.0
#: Letters that could be a word.
WORDLIKE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Words with a short number after them, numbers, dates and times, between separators. Possessive: a text that doesn't match is left after one reading.
_PIECE = r"(?:[A-Za-z]++\d{0,4}+|\d++(?:T\d++)?+Z?+)"
IDENTIFIER = re.compile(rf"{_PIECE}(?:[_/=+-]++{_PIECE}?+)*+")
#: Characters whose tokens are counted at once: what the vocabulary's library does with one long run grows with its square.
STEP = 4096
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
MASK = "[SECRET]"

Span = tuple[int, int, str]


def base_spans(text: str, raw: bytes) -> list[Span]:
    """(start, end, kind), by start and then kind as listed in KINDS."""
    out: list[Span] = []
    low = raw.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # runs of 24 or more are what leftmost maximal runs leave once shorter ones are dropped
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def efficient(part: str, encoding, efficiency: float) -> bool:
    """Whether the vocabulary spells the part with at least ``efficiency`` characters per token; long ones are counted in steps of ``STEP``.

    Letters that could be a word are spelt in lower case if they are capitals, and pass with ``WORD_EFFICIENCY``.
    """
    if WORDLIKE.fullmatch(part):
        part, efficiency = part.lower() if part.isupper() else part, min(efficiency, WORD_EFFICIENCY)
    tokens = sum(len(encoding.encode_ordinary(part[k : k + STEP])) for k in range(0, len(part), STEP))
    return len(part) >= efficiency * tokens


def excluded(run: str, encoding, efficiency: float = EFFICIENCY) -> bool:
    """Whether a run is a digest, a UUID, a number, a date or an identifier.

    An identifier's long words are words only if they compress like words; where they
    repeat few letters, any vocabulary spells them badly, and they stay identifiers.
    """
    core = run.strip("=_-+/")
    if len(core) in DIGEST_LENGTHS and DIGITS.fullmatch(core) or UUID.fullmatch(core):
        return True
    return bool(IDENTIFIER.fullmatch(core)) and all(len(set(w)) <= 5 or efficient(w, encoding, efficiency) for w in WORD.findall(core))


def _merged(base: list[Span]) -> list[tuple[int, int]]:
    """Base spans as disjoint stretches of text, in order."""
    out: list[tuple[int, int]] = []
    for s, e, _ in sorted(base):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def _uncovered(runs: Iterator[tuple[int, int]], base: list[Span], shortest: int) -> Iterator[tuple[int, int]]:
    """What base spans leave of runs, both in order; one sweep."""
    covered, k = _merged(base), 0
    for start, end in runs:
        while k < len(covered) and covered[k][0] < end:
            s, e = covered[k]
            if s - start >= shortest:
                yield start, s
            start = max(start, e)
            if e >= end:
                break  # this stretch may reach into the next run
            k += 1
        if end - start >= shortest:
            yield start, end


class Scanner:
    def __init__(self, data: bytes, efficiency: float = EFFICIENCY, shortest: int = SHORTEST):
        import tiktoken

        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(data), special_tokens={})
        self.efficiency, self.shortest = efficiency, shortest
        self.run = re.compile(rf"[A-Za-z0-9+/_=-]{{{shortest},}}")
        self.part = re.compile(rf"[A-Za-z0-9]{{{shortest},}}")

    def random(self, part: str) -> bool:
        return not excluded(part, self.encoding, self.efficiency) and not efficient(part, self.encoding, self.efficiency)

    def random_spans(self, text: str, base: list[Span]) -> list[Span]:
        """Runs, or the parts of them between separators, that are random; of runs that base spans touch, the rest."""
        out: list[Span] = []
        for start, end in _uncovered(((m.start(), m.end()) for m in self.run.finditer(text)), base, self.shortest):
            if self.random(text[start:end]):
                out.append((start, end, "random"))
            else:
                out += [(start + p.start(), start + p.end(), "random") for p in self.part.finditer(text[start:end]) if p.end() - p.start() < end - start and self.random(p[0])]
        return out

    def spans(self, raw: bytes) -> tuple[list[Span], list[Span]]:
        """Base spans and all spans."""
        text = raw.decode()
        base = base_spans(text, raw)
        return base, sorted(base + self.random_spans(text, base), key=_order)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _vocabulary(df: DataFrame, path: str | None):
    return df.sparkSession.sparkContext.broadcast(rank_file(path or public_tokenizers.path(VOCABULARY)))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, efficiency: float = EFFICIENCY, shortest: int = SHORTEST) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    data = _vocabulary(docs, path)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        scanner = Scanner(data.value, efficiency, shortest)
        for batch in pieces(batches, 1):
            found = [scanner.spans(t) for t in texts_of(batch.column(1))]
            counts = [pa.array([sum(s[2] == k for s in every) for _, every in found], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts[:3], digest, pa.array([listed(every) for _, every in found], pa.string()), counts[3]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", path: str | None = None, efficiency: float = EFFICIENCY, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with every span replaced by a mask (overlapping ones by one); texts without any stay as they are.

    ``length_col``, if there is one, gets the new length of the texts that change.
    """
    data = _vocabulary(docs, path)
    columns = docs.columns
    sized = length_col if length_col in columns else None

    def run(batches):
        scanner = Scanner(data.value, efficiency, shortest)
        for batch in pieces(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            texts, arrays = batch.column(at).to_pylist(), list(batch.columns)
            lengths = batch.column(sized).to_pylist() if sized else []
            for k, text in enumerate(texts):
                spans = scanner.spans(text.encode())[1] if text else []
                if spans:
                    parts, last = [], 0
                    for start, end, _ in spans:
                        if start >= last:
                            parts += [text[last:start], MASK]
                        last = max(last, end)
                    texts[k] = "".join([*parts, text[last:]])
                    if sized:
                        lengths[k] = len(texts[k])
            arrays[at] = pa.array(texts, batch.schema.field(at).type)
            if sized:
                i = batch.schema.get_field_index(sized)
                arrays[i] = pa.array(lengths, batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
