"""Shards, fill-in-the-middle and spelling variants against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from indicata.llm import fill_middle, queries, sharding, spelling

DOCS = "doc_id long, text string, lang string, shard int, slot string, n long, hash string, word string, text_ string"
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    """Documents with extra columns whose names clash with results and inner columns."""
    return spark.createDataFrame([(i, t, None, 1, "x", 2, "h", "w", None) for i, t in rows], DOCS)


@pytest.mark.parametrize("name", ["op11_sharding", "op12_fill_middle", "op13_spelling"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    df = queries.queries()[name](spark, SF)
    key = lambda r: [(x is None, x) for x in r]
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=key)
    want = sorted(con.sql(f"select {', '.join(sorted(df.columns))} from ({queries.oracle_sql()[name]})").fetchall(), key=key)
    assert got and got == want


# 11


def jump(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def key_of(value) -> int:
    return int(hashlib.md5(("" if value is None else str(value)).encode()).hexdigest()[:16], 16)


@pytest.mark.parametrize("shards", [1, 2, 7, 32, 33, 1000])
def test_jumps(spark, shards):
    rows = spark.range(300).select("id", sharding.shard_of(F.col("id"), shards).alias("s")).collect()
    assert {r.id: r.s for r in rows} == {i: jump(key_of(i), shards) for i in range(300)}


def test_shards_of_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 3)
    rows = [(i, f"text {i % 7}") for i in range(500)] + [(5, "text 5")] * 20 + [(None, None)] * 10 + [(None, ""), (7, ""), (7, None), (8, "é€😀" * 40_000)]
    out = sharding.place(docs(spark, rows)).collect()
    assert out and out[0].asDict().keys() == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    size = lambda t: len((t or "").encode()) + 16
    want = Counter((i, size(t), zlib.crc32((t or "").encode()), "key", jump(key_of(i), 40), jump(key_of(i), 41)) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in out) == want
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # the same rows in another layout get the same slots
    again = sharding.place(docs(spark, rows[::-1]).repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))
    assert sharding.place(docs(spark, [])).collect() == []


def test_shards_keep_groups_and_files(spark, tmp_path):
    rows = [(str(i), f"g{i % 30}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id string, grp string, n int")
    sharding.write_shards(df, f"{tmp_path}/out", 8, key_cols=["grp"], files=2)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.doc_id, r.grp, r.n) for r in back) == sorted(rows)
    assert {(r.grp, r.shard) for r in back} == {(g, jump(key_of(g), 8)) for g in {r[1] for r in rows}}
    placed = sharding.place(df.withColumn("text", F.lit("x"))).collect()
    assert {r.doc_id: r.shard for r in placed} == {i: jump(key_of(i), 40) for i, _, _ in rows}


# 12


def fim(doc_id, text):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_boundaries():
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choices("ab é€😀", k=rng.choice([0, 1, 2, 63, 64, 500, 5000])))
        index = fill_middle.Boundaries(text.encode())
        assert index.n == len(text)
        for k in {0, 1 % (index.n + 1), index.n, rng.randint(0, index.n)}:
            assert index.select(k) == len(text[:k].encode())
    # sparse offsets use low bits: only continuation bytes between two starts
    index = fill_middle.Boundaries(b"a" + b"\x80" * 1000 + b"b")
    assert index.low > 0 and [index.select(k) for k in range(3)] == [0, 1001, 1002]


@pytest.mark.parametrize("hot", [4096, 3])
def test_cuts_of_odd_tables(spark, hot):
    texts = ["", None, "a", "é€😀 plain", "holds <P> already", "ends with <", "<S", ">" * 30, "😀" * 50_000, "a\r\n\x00b"]
    rows = [(i, texts[i % len(texts)]) for i in range(200)] + [(3, "é€😀 plain")] * 5 + [(None, "a"), (None, None)] + [(1000 + i, "copy of one text") for i in range(60)]
    out = fill_middle.transformed(docs(spark, rows), hot=hot).collect()
    assert Counter(map(tuple, out)) == Counter((i, *fim(i, t)) for i, t in rows)
    for r in out:
        assert fill_middle.restore(r.output.encode(), r.form).decode() in {t or "" for _, t in rows}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter((i, *fim(i, t)[:4], digest(fim(i, t)[4]), digest(t or "")) for i, t in rows)
    assert Counter(map(tuple, fill_middle.digests(docs(spark, rows), hot=hot).collect())) == want
    assert fill_middle.digests(docs(spark, [])).collect() == []
    text_ids = spark.createDataFrame([("a", "bc" * 20)], "doc_id string, text string")
    assert tuple(fill_middle.transformed(text_ids).first()) == ("a", *fim("a", "bc" * 20))


# 13


def vocabulary(rows):
    import re

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows):
    words = vocabulary(rows)
    near = {w: [x for x in words if is_near(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = Counter()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root] += 1
    return out


COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


@pytest.mark.parametrize("hot", [20_000, 4])
def test_variants(spark, hot):
    rng = random.Random(hot)
    stems = ["aaaaaaa", "aaaaaaaa", "abababab", "ababababa", "Customer", "customer", "naïveté", "ÀÉÎÕÜÿñ", "z" * 3000, "z" * 3001, "straßenbahn"]
    words = []
    for _ in range(400):
        w = list(rng.choice(stems[:8] + stems[10:]))
        for _ in range(rng.choice([0, 1, 1, 2])):
            k = rng.randrange(len(w))
            rng.choice([lambda: w.pop(k), lambda: w.insert(k, rng.choice("abé")), lambda: w.__setitem__(k, rng.choice("abé"))])()
        words.append("".join(w))
    rows = [(i, " ".join(rng.choices(words, k=40)) + ", " + "customers! ") for i in range(40)]
    # chains of forms: each ten times as frequent as the one before
    rows += [(100 + k, " ".join([w] * n)) for k, (w, n) in enumerate((("qqqqqqq", 3), ("qqqqqqr", 40), ("qqqqqrr", 500), ("qqqqrrr", 6000)))]
    rows += [(None, "anonymous anonymous"), (7, None), (7, ""), (8, "× ÷ 123"), *[(9, "repeated rows")] * 3, (11, "z" * 3000 + " " + "z" * 3001), (12, "z" * 3000 + " " + "z" * 3001)]
    got = Counter(tuple(r[c] for c in COLUMNS) for r in spelling.variants(docs(spark, rows), hot=hot).collect())
    want = brute_variants(rows)
    assert got == want
    assert any(w[0] == "qqqqqqq" and w[5] != w[3] for w in want)


def test_no_variants(spark):
    assert spelling.variants(docs(spark, [])).collect() == []
    assert spelling.variants(docs(spark, [(1, "short words only here")])).collect() == []


def test_cuts_never_take_another_text(spark, monkeypatch):
    """Where a group's text isn't the document's own, the job fails."""
    wrong = spark.createDataFrame([(1, "one text")], "doc_id long, text string").withColumn("sha", F.unhex(F.sha2(F.lit("another"), 256)))
    monkeypatch.setattr(fill_middle, "_paired", lambda *_: wrong)
    with pytest.raises(Exception, match="two texts have the same length"):
        fill_middle.digests(wrong).collect()
