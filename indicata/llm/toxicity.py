"""Toxicity scores from a lexicon matched with Levenshtein automata.

The lexicon is learned from labelled documents: whole words, and stems (beginnings
of words, for words that appear with many endings), that are frequent in toxic and
practically absent from other documents. It lies in a trie. A document's word is
read as a Levenshtein automaton of one edit, and the automaton and the trie are walked together: branches of the trie that no
spelling within one edit reaches are never entered. Words shorter than
``fuzzy_length`` only match exactly.

Each match is seen in its context window: a match within quotation marks, or with
a verb of saying beside it, counts as quoted. Counts of plain and quoted, exact
and misspelled matches, their density and how many stand near another one are the
features of a logistic regression, whose weights are learned as well.

Scale: the lexicon and weights are fitted on at most ``max_fit`` labelled rows, those
whose ids have the smallest hashes; the fitted model is a few kilobytes. Scoring is
one pass without a shuffle, in which the distinct words of a slice of texts walk the
trie together.

Edge cases: null and empty texts have no matches and get the model's base score.
Labels that are null, and labelled rows without a document, are left out. Without
toxic labels the lexicon is empty, and all scores are low. Repeated rows are each
scored. Words of any length are read whole; words below ``SHORTEST`` bytes are read but
not learned as terms.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, pieces, settle, slices, texts_of

MAX_FIT = 20_000
CUT = 0.7
FUZZY_LENGTH = 5
STEMS = (4, 5, 6, 7)
#: Bytes of the shortest word that is learned.
SHORTEST = 3
#: Words to either side of a match that are its context.
CONTEXT = 6
QUOTES = re.compile("[\"“”„«»‹›]")
#: Verbs and nouns of reporting, in the languages at hand.
REPORTING = frozenset(b"said says say called calls wrote writes quoted quote quotes term word words slur insult sagte sagt nannte wort schrieb dit disait mot appela dijo dice palabra llam\xc3\xb3".split())
FEATURES = 7


@dataclass
class Trie:
    """Terms by byte; ``stem`` is None where no term ends, else whether any word that starts with it matches."""

    child: dict[int, Trie] = field(default_factory=dict)
    stem: bool | None = None
    height: int = 0

    def add(self, term: bytes, stem: bool) -> None:
        node = self
        self.height = max(self.height, len(term))
        for c in term:
            node = node.child.setdefault(c, Trie())
        node.stem = bool(node.stem) or stem


def match(trie: Trie, letters: np.ndarray, lengths: np.ndarray, fuzzy_length: int = FUZZY_LENGTH) -> np.ndarray:
    """Per word: 0 for no term, 1 for a term as it is, 2 for a term within one edit.

    ``letters`` has at least the first ``trie.height + 2`` bytes of each word, then
    zeros. Each word is an automaton of at most one edit. After d letters of a term
    its state is whether d letters of the word match them without an edit, and which
    of d - 1, d and d + 1 letters of the word match them with one. The trie is walked
    once with the automata of all words; a branch keeps the words that still live.
    """
    out = np.zeros(len(letters), np.int8)
    none = np.zeros(len(letters), bool)
    fuzzy = lengths >= fuzzy_length
    stack = [(trie, 0, np.arange(len(letters)), ~none, none, none, fuzzy)]
    while stack:
        node, d, rows, exact, less, same, more = stack.pop()
        if node.stem is not None:
            n = lengths[rows]
            out[rows[exact if node.stem else exact & (n == d)]] = 1
            if d >= fuzzy_length:
                edit = less | same | more if node.stem else less & (n == d - 1) | same & (n == d) | more & (n == d + 1)
                at = rows[edit]
                out[at[out[at] == 0]] = 2
        if not node.child:
            continue
        here, after = letters[rows, d], letters[rows, d + 1]
        before = letters[rows, d - 1] if d else np.zeros(len(rows), np.uint8)
        free = exact & fuzzy[rows]
        replaced = free & (here != 0)
        for c, kid in node.child.items():
            hit = here == c
            e = exact & hit
            state = e, less & (before == c) | free, same & hit | replaced, more & (after == c) | free & hit & (after != 0)
            live = np.flatnonzero(state[0] | state[1] | state[2] | state[3])
            if len(live):
                stack.append((kid, d + 1, rows[live], *(x[live] for x in state)))
    return out


@dataclass
class Model:
    terms: list[tuple[bytes, bool]]
    weights: list[float]

    def trie(self) -> Trie:
        root = Trie()
        for term, stem in self.terms:
            root.add(term, stem)
        return root


class Scanner:
    """Features of texts under a lexicon."""

    def __init__(self, trie: Trie):
        self.trie = trie

    def features(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), FEATURES))
        for a, b in slices([len(t) for t in texts]):
            words = Words(texts[a:b])
            if len(words.starts):
                self._slice(words, texts[a:b], out[a:b])
        return out

    def _slice(self, words: Words, texts: list[bytes], out: np.ndarray) -> None:
        _, at, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        lengths = words.ends[at] - words.starts[at]
        width = self.trie.height + 2
        padded = np.concatenate([words.low, np.zeros(width, np.uint8)])
        letters = as_strided(padded, shape=(len(padded) - width + 1, width), strides=(1, 1))[words.starts[at]]
        letters[np.arange(width) >= lengths[:, None]] = 0
        code = match(self.trie, letters, lengths)[back]
        hits = np.flatnonzero(code)
        doc = np.searchsorted(words.first, hits, "right") - 1
        offset = np.cumsum([0] + [len(t) + 1 for t in texts])
        near = np.zeros(len(hits), bool)
        if len(hits) > 1:
            close = (np.diff(hits) <= 2 * CONTEXT) & (np.diff(doc) == 0)
            near[1:] |= close
            near[:-1] |= close
        for k, (i, d) in enumerate(zip(hits.tolist(), doc.tolist())):
            lo, hi = int(words.first[d]), int(words.first[d + 1])
            quoted = self._quoted(words, texts[d], int(offset[d]), i, lo, hi)
            edits = int(code[i]) - 1
            out[d, 2 * quoted + edits] += 1
            out[d, 4] += bool(near[k]) and not quoted
        count = np.diff(words.first).astype(float)
        total = out[:, :4].sum(axis=1)
        out[:, 5] = np.where(total > 0, np.log1p(1000 * total / np.maximum(count, 1)), 0)
        out[:, 6] = total > 0
        out[:, :5] = np.log1p(out[:, :5])

    @staticmethod
    def _quoted(words: Words, text: bytes, offset: int, i: int, lo: int, hi: int) -> bool:
        a, b = max(lo, i - CONTEXT), min(hi, i + CONTEXT + 1)
        before = text[words.starts[a] - offset : words.starts[i] - offset].decode(errors="replace")
        after = text[words.ends[i] - offset : words.ends[b - 1] - offset + 4].decode(errors="replace")
        if QUOTES.search(before) and QUOTES.search(after):
            return True
        return any(words.word(k) in REPORTING for k in range(max(lo, i - 2), min(hi, i + 3)) if k != i)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of learning."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def _fit_rows(docs: DataFrame, labels: DataFrame, max_fit: int) -> DataFrame:
    """(text, y) of the labelled documents that are learned from: at most ``max_fit``, by hash of their ids."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    some = usable.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("y"))
    some = some.orderBy(F.xxhash64("_id"), "_id").limit(max_fit)
    ids = docs.sparkSession.createDataFrame(some.collect() or [], "_id long, y int")
    # max_fit rows of two numbers: small enough to send to every task
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(ids), "_id").select("text", "y")


def _marks(word: bytes) -> list[bytes]:
    """A word's marks: itself, with a $ at its end, and its stems."""
    return [word + b"$", *(word[:k] for k in STEMS if len(word) > k)]


def learn_lexicon(fit: DataFrame, min_contexts: int = 3, min_ratio: float = 30.0, min_endings: int = 3) -> list[tuple[bytes, bool]]:
    """Terms and stems that mark toxic documents, from counts made on the executors.

    A word's or stem's support is the number of different contexts (neighbouring
    words) it has in toxic documents, so that copies of one document lend it no more
    than one. It is kept if toxic documents hold it ``min_ratio`` times as often as
    others, and if not even one mark would be expected to come so far by chance. A
    stem also needs several words; it stands for them and for all longer stems.
    """

    def seen(batches):
        for batch in pieces(batches, 0):
            rows = set()
            for text in texts_of(batch.column(0)):
                words = Words([text])
                own = [words.data[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist())]
                for before, w, after in zip([b"", *own], own, [*own[1:], b""]):
                    if len(w) >= SHORTEST:
                        rows.add((w, before + b" " + after))
            marks = [(m.decode("latin-1"), w.decode("latin-1"), c.decode("latin-1")) for w, c in rows for m in _marks(w)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*marks)] if marks else [pa.array([], pa.string())] * 3, names=["term", "word", "context"])

    sizes = fit.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("y") > 0).cast("int")), F.lit(0)).alias("toxic")).first()
    n_toxic, n_clean = sizes["toxic"], sizes["n"] - sizes["toxic"]
    if not n_toxic:
        return []
    contexts = fit.where("y > 0").mapInArrow(seen, "term string, word string, context string").select("term", "word", F.xxhash64("context").alias("context")).distinct()
    support = contexts.groupBy("term", "word").agg(F.count("*").alias("t")).groupBy("term").agg(F.sum("t").alias("t"), F.count("*").alias("words"))
    support = support.where((F.col("t") >= min_contexts) & (F.endswith("term", F.lit("$")) | (F.col("words") >= min_endings)))
    support = settle(support.select("term", "t"))
    n_marks = support.count()
    if not n_marks:
        return []

    def documents(batches):
        for batch in pieces(batches, 0):
            counts: dict[tuple[bytes, int], int] = {}
            for text, y in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                words = Words([text])
                own = {words.data[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist())}
                for m in {m for w in own for m in _marks(w)}:
                    counts[m, int(y > 0)] = counts.get((m, int(y > 0)), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([m.decode("latin-1") for m, _ in counts], pa.string()), pa.array([y for _, y in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["term", "y", "n"])

    enough = math.log(max(2, n_marks)) / -math.log(n_toxic / (n_toxic + n_clean + 1))
    held = fit.mapInArrow(documents, "term string, y int, n long").groupBy("term").agg(*(F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(k) for y, k in ((0, "clean"), (1, "toxic"))))
    share = F.col("toxic") / F.lit(n_toxic) / ((F.col("clean") + 0.5) / F.lit(max(1, n_clean)))
    # only marks that pass both tests leave the executors
    passed = support.where(F.col("t") >= enough).join(held, "term").where(share >= min_ratio).select("term", "t")
    found = {r["term"].encode("latin-1"): r["t"] for r in passed.collect()}
    stems: list[bytes] = []
    for s in sorted((s for s in found if not s.endswith(b"$")), key=lambda s: (len(s), s)):
        # one word that makes up most of a stem is no stem
        alone = any(2 * found[w] > found[s] for w in found if w.endswith(b"$") and w.startswith(s))
        if not alone and not any(s.startswith(x) for x in stems):
            stems.append(s)
    words = [w[:-1] for w in sorted(found, key=lambda w: (-found[w], w)) if w.endswith(b"$") and not any(w.startswith(s) for s in stems)]
    return [*((s, True) for s in stems), *((w, False) for w in words)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * max(1.0, len(x) / 1000))
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Model:
    # max_fit documents, written once: the passes below don't read the whole table again
    rows = settle(_fit_rows(docs, labels, max_fit))
    terms = learn_lexicon(rows)
    trie = Model(terms, []).trie()

    def run(batches):
        scanner = Scanner(trie)
        for batch in pieces(batches, 0):
            x = scanner.features(texts_of(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["x", "y"])

    # equal feature vectors come as one row with a count: what reaches the driver is at most max_fit short rows
    pairs = rows.mapInArrow(run, "x array<double>, y int").groupBy("x", "y").count().collect()
    if not any(r["y"] > 0 for r in pairs):
        return Model(terms, [0.0] * FEATURES + [-6.0])
    n = np.array([r["count"] for r in pairs])
    x, y = np.array([r["x"] for r in pairs]), np.array([float(r["y"] > 0) for r in pairs])
    return Model(terms, logistic(np.repeat(x, n, axis=0), np.repeat(y, n)).tolist())


def _scores(model: Model, features: np.ndarray) -> np.ndarray:
    w = np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(features @ w[:-1] + w[-1], -35, 35)))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    trie = model.trie()

    def run(batches):
        scanner = Scanner(trie)
        for batch in pieces(batches, 1):
            s = _scores(model, scanner.features(texts_of(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, *, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``docs`` without those that score ``cut`` or more; one pass, no shuffle."""
    trie = model.trie()

    def run(batches):
        scanner = Scanner(trie)
        for batch in pieces(batches, text_col):
            s = _scores(model, scanner.features(texts_of(batch.column(batch.schema.get_field_index(text_col)))))
            yield batch.filter(pa.array(s < cut))

    return docs.mapInArrow(run, docs.schema)
