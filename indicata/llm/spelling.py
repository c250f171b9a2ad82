"""Spelling variants of a corpus's words: a trie joined with itself by active-node sets.

Words are counted over all texts. Two words are near if one code point is inserted,
deleted or replaced. They are found by walking a trie of the vocabulary and keeping, for
each node, the nodes at distance one of it: siblings (a replacement), a node and its
parent (an insertion), and what such pairs lead to by equal letters. Where both nodes
of a pair end a word, the words are near.

The trie is partitioned by prefix. Of two near words, the shorter ``m`` code points
long, one edit lies either beyond the first half of it, and they share that prefix, or within,
and they share the ending. So each word goes below its first m // 2 code points and before its
last m - m // 2, once for each m it can have with a partner (its length and one less), and
what is left of the words below one such part is a subtrie that holds all of their pairs.
A pair found under its ending is passed over if it shares the prefix too, so it comes once.

Scale: the vocabulary is counted before it is dealt. A part shared by more than ``HOT`` words is
cut again by the same rule, into halves of what is left, until it is small or a single code point
is left; no part is capped, and none needs another one's words. Within a worker many
parts are walked at once, level by level, in arrays. Counts of near words and the choice of
forms are aggregates over pairs; roots follow forms by pointer doubling, in as many rounds as the
logarithm of the longest chain (a form is ten times as frequent, so chains are short).

Edge cases: null and empty texts have no words; a null id counts as an empty one where letters are
deleted; repeated rows count again. Ties of frequency go to the word that is smaller in code point
order. An empty table, or one without a frequent word, has no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_whole_groups, settle
from .sharding import text_crc32_sql

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a letter; the least length and number of a word; how much more frequent a form is.
SLIP, LEAST_LENGTH, LEAST_COUNT, RATIO = 31, 7, 2, 10
#: Words that share a part, above which it is cut again.
HOT = 20_000
#: Bits of a code point in a child's key.
BITS = 21


def _slipped(doc_id: Column, run: Column) -> Column:
    """A lower-cased run, without one code point where the checksum of id and run asks for it."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % SLIP == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("run"))
    words = runs.where(F.length("run") >= LEAST_LENGTH).select(_slipped(F.col("id"), F.translate("run", UPPER, LOWER)).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _half(fixed: Column, before: Column, rest: Column, least: Column) -> Column:
    """The two places of a remainder whose pairs are ``least`` code points long at least: below its first half, before its last.

    ``fixed`` is what all words of a place share, ``before`` of its code points stand before the remainder.
    """
    first = F.floor(least / 2).cast("int")
    last = least - first
    head, tail = F.substring(fixed, F.lit(1), before), F.substring(fixed, before + 1, F.length(fixed))
    kept = F.length(rest) - last
    below = F.struct(F.concat(head, F.substring(rest, F.lit(1), first), tail).alias("fixed"), (before + first).alias("before"), F.substring(rest, first + 1, F.length(rest)).alias("rest"), last.alias("least"))
    ahead = F.struct(F.concat(head, F.substring(rest, kept + 1, last), tail).alias("fixed"), before.alias("before"), F.substring(rest, F.lit(1), kept).alias("rest"), first.alias("least"))
    return F.array(below, ahead)


def _placed(rows: DataFrame) -> DataFrame:
    place = rows.select("n", F.explode("places").alias("p")).select("n", "p.*")
    return place.select(F.xxhash64("fixed", "before", "least").alias("place"), "fixed", "before", "rest", "least", "n")


def places(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(place, fixed, before, rest, least, n): every word in all places where it can meet a near one."""
    length = F.length("word")
    whole = lambda least: _half(F.lit(""), F.lit(0), F.col("word"), least)
    todo = _placed(words.select("n", F.when(length > LEAST_LENGTH, F.concat(whole(length), whole(length - 1))).otherwise(whole(length)).alias("places")))
    done = None
    while True:
        # what is left of a single code point can't be cut, and is bounded by the number of letters
        large = settle(todo.where("least > 1").groupBy("place").agg(F.count("*").alias("words")).where(F.col("words") > hot).select("place"))
        small = todo if large.isEmpty() else todo.join(large, "place", "left_anti").union(todo.join(large, "place", "left_semi").where("least <= 1").select(todo.columns))
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return done
        cut = todo.join(large, "place", "left_semi").where("least > 1")
        todo = settle(_placed(cut.select("n", _half(F.col("fixed"), F.col("before"), F.col("rest"), F.col("least")).alias("places"))))


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``count`` numbers from ``first``: the range that each number belongs to, and the numbers."""
    of = np.repeat(np.arange(len(first)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]


class Level:
    """Nodes of one depth, in order of their words: rows below each, the row that ends there (or -1), key of parent and letter."""

    def __init__(self, rows: np.ndarray, node: np.ndarray, keys: np.ndarray, ends: np.ndarray):
        self.rows, self.node, self.keys = rows, node, keys
        self.count = np.bincount(node, minlength=len(keys))
        self.end = np.full(len(keys), -1)
        at = np.flatnonzero(ends)
        self.end[node[at]] = rows[at]

    def child(self, parent: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The nodes of these keys, or -1; parents are of the level above."""
        key = parent << BITS | letter
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        return np.where(self.keys[at] == key, at, -1) if len(self.keys) else np.full(len(key), -1)


def near_pairs(part: np.ndarray, least: np.ndarray, tail: np.ndarray, sizes: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of near remainders: of one part, i ``least`` letters long, j as long or one longer.

    Rows come sorted by part and letters, all of a part different; ``tail`` tells whether parts share an ending, where a
    pair whose longer remainder only goes on after the shorter one is left to the place of its prefix.
    """
    first = np.cumsum(sizes) - sizes
    found: list[tuple[np.ndarray, np.ndarray]] = []
    new = np.append(True, part[1:] != part[:-1])
    node = np.cumsum(new) - 1
    rows = np.arange(len(part))
    level = Level(rows, node, np.arange(int(new.sum())), sizes == 0)
    none = np.zeros(0, np.int64)
    above, same, longer = None, (none, none), (none, none)
    depth = 0
    while len(level.rows):
        # nodes that can still lead to a pair: of several rows, or met by another node
        needed = level.count > 1
        needed[same[0]] = needed[same[1]] = needed[longer[0]] = True
        if above is not None and len(longer[1]):
            lows = np.unique(longer[1])
            _, kids = _expand(np.searchsorted(level.keys, lows << BITS), np.searchsorted(level.keys, lows + 1 << BITS) - np.searchsorted(level.keys, lows << BITS))
            needed[kids] = True
        live = needed[level.node] & (sizes[level.rows] > depth)
        rows, node = level.rows[live], level.node[live]
        if not len(rows):
            break
        key = node << BITS | letters[first[rows] + depth]
        new = np.append(True, key[1:] != key[:-1])
        below = Level(rows, np.cumsum(new) - 1, key[new], sizes[rows] == depth + 1)
        parent, letter = below.keys >> BITS, below.keys & (1 << BITS) - 1
        start, stop = np.searchsorted(parent, np.arange(len(level.count))), np.searchsorted(parent, np.arange(len(level.count)), "right")
        # replacements: two children of one node, and children by the same letter of two nodes that differ already
        kid = np.arange(len(parent))
        of, sibling = _expand(kid + 1, stop[parent] - kid - 1)
        a, b = same
        by, one = _expand(start[a], stop[a] - start[a])
        two = below.child(b[by], letter[one])
        same = np.concatenate([kid[of], one[two >= 0]]), np.concatenate([sibling, two[two >= 0]])
        # insertions: a child and its parent, and what earlier ones lead to by the same letter
        x, y = longer
        by, up = _expand(start[x], stop[x] - start[x])
        low = level.child(y[by], letter[up]) if above is not None else none
        good = (low >= 0) & (low != parent[up]) if len(low) else np.zeros(0, bool)
        own = np.flatnonzero(level.count[parent] > 1)
        longer = np.concatenate([own, up[good]]), np.concatenate([parent[own], low[good]])
        i, j = below.end[same[0]], below.end[same[1]]
        ok = (i >= 0) & (j >= 0)
        ok[ok] = least[i[ok]] == depth + 1
        found.append((i[ok], j[ok]))
        i, j = level.end[longer[1]], below.end[longer[0]]
        ok = (i >= 0) & (j >= 0)
        ok[: len(own)] &= ~tail[np.maximum(i[: len(own)], 0)]
        ok[ok] &= least[i[ok]] == depth
        found.append((i[ok], j[ok]))
        above, level = level, below
        depth += 1
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none)


def pairs(placed: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of near words, in both directions, each once."""

    def work(group: pa.Table) -> pa.RecordBatch | None:
        group = group.combine_chunks()
        fixed, before, rest, least, n = (group.column(c).chunk(0) for c in ("fixed", "before", "rest", "least", "n"))
        before, least = before.to_numpy(), least.to_numpy()
        changed = pc.not_equal(fixed.slice(1), fixed.slice(0, len(fixed) - 1)).to_numpy(zero_copy_only=False) if len(fixed) > 1 else np.zeros(0, bool)
        part = np.cumsum(np.append(True, changed | (before[1:] != before[:-1]) | (least[1:] != least[:-1])))
        several = np.bincount(part)[part] > 1
        at = np.flatnonzero(several)
        if not len(at):
            return None
        fixed, rest, n = fixed.take(pa.array(at)), rest.take(pa.array(at)), n.to_numpy()[at]
        before, least, part = before[at], least[at].astype(np.int64), part[at]
        sizes = pc.utf8_length(rest).to_numpy().astype(np.int64)
        letters = np.frombuffer("".join(rest.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        tail = pc.utf8_length(fixed).to_numpy() > before
        i, j = near_pairs(part, least, tail, sizes, letters)
        if not len(i):
            return None
        used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
        words = pa.array([f[:b] + r + f[b:] for f, b, r in zip(fixed.take(pa.array(used)).to_pylist(), before[used].tolist(), rest.take(pa.array(used)).to_pylist())], pa.string())
        left, right = words.take(pa.array(back)), words.take(pa.array(np.concatenate([back[len(i) :], back[: len(i)]])))
        ij, ji = np.concatenate([i, j]), np.concatenate([j, i])
        return pa.RecordBatch.from_arrays([left, pa.array(n[ij]), right, pa.array(n[ji])], names=["word", "n", "other", "other_n"])

    return map_whole_groups(placed, "place", work, "word string, n long, other string, other_n long", order=("fixed", "before", "least", "rest"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by pointer doubling."""
    state = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if state.join(ahead, "root", "left_semi").isEmpty():
            return state
        state = settle(state.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = settle(vocabulary(docs, id_col=id_col, text_col=text_col))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = pairs(places(words, hot)).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.join(near, "word", "left")
    is_form = -F.col("best.less") >= RATIO * F.col("n")
    rows = settle(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


ORACLE_SQL = f"""
with runs as (
  select id, run, count(*) as n from (
    select coalesce(doc_id::varchar, '') as id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')), '{UPPER}', '{LOWER}') as run from documents
  ) where length(run) >= {LEAST_LENGTH} group by id, run
), slips as (
  select run, n, ({text_crc32_sql("id || ':' || run")})::bigint as h from runs
), words as (
  select word, sum(n)::bigint as n from (
    select n, case when h % {SLIP} = 0 then substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) else run end as word from slips
  ) where length(word) >= {LEAST_LENGTH} group by word having sum(n) >= {LEAST_COUNT}
), cuts as (
  select word, n, i, substring(word, 1, i - 1) as p, substring(word, i + 1) as s from words, unnest(range(1, length(word) + 1)) as t(i)
), near as (
  select a.word, b.word as other, b.n as other_n from cuts a join cuts b on a.i = b.i and a.p = b.p and a.s = b.s and a.word <> b.word
  union
  select a.word, b.word, b.n from cuts a join words b on a.p || a.s = b.word
  union
  select b.word, a.word, a.n from cuts a join words b on a.p || a.s = b.word
), best as (
  select w.word, w.n, count(near.other) as n_near, first(near.other order by near.other_n desc, near.other) as form, first(near.other_n order by near.other_n desc, near.other) as form_n
  from words w left join near using (word) group by w.word, w.n
), formed as (
  select word, n, n_near, case when form_n >= {RATIO} * n then form end as form, case when form_n >= {RATIO} * n then form_n end as form_n from best
), recursive_roots as (
  with recursive chain as (
    select word, word as root, 0 as step from formed
    union all
    select chain.word, formed.form, step + 1 from chain join formed on chain.root = formed.word where formed.form is not null
  ) select word, max_by(root, step) as root from chain group by word
)
select word, n, n_near, form, form_n, root from formed join recursive_roots using (word)
"""
