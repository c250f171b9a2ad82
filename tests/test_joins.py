"""Joins with tables of any size, against plain Python."""

import datetime as dt
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from indicata.operators import asof, neighbours, patterns, ranges, redirects, suffixes


def _rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# suffix rules


def _suffix_labels(host, rules):
    parts, found = host.split("."), []
    for rule in rules:
        labels = rule.lstrip("!").split(".")
        if len(labels) <= len(parts) and all(r in ("*", p) for r, p in zip(reversed(labels), reversed(parts))):
            found.append((rule[0] == "!", len(labels) - (rule[0] == "!")))
    return max(found)[1] if found else 1


def test_suffix_rules(spark, tmp_path):
    rules = ["com", "uk", "co.uk", "*.ck", "!www.ck", "*.kawasaki.jp", "jp", "!city.kawasaki.jp", "a.b.c.d"]
    spark.createDataFrame([(r,) for r in [*rules, " CO.UK ", "// note", "", None]], "rule string").write.parquet(f"{tmp_path}/rules")
    table = suffixes.rule_file(spark, f"{tmp_path}/rules")
    rng = random.Random(1)
    hosts = [".".join(rng.choices("www a b c d com uk co ck kawasaki jp city x".split(), k=rng.randint(1, 6))) for _ in range(300)]
    given = [*hosts, *hosts[:50], "www.ck", "city.kawasaki.jp", "1.2.3.4", "2001:db8::1", "", None, "HTTPS://WWW.Paypal.CO.UK:443/x", "unknown.tld"]
    df = spark.createDataFrame(list(enumerate(given)), "n int, host string").withColumn("base", F.lit("clash"))
    out = {r.n: r.split for r in suffixes.with_suffix_split(df, table).collect()}
    assert len(out) == len(given)
    for n, host in enumerate(given):
        got, h = out[n], (host or "").lower()
        if "/" in h:
            assert tuple(got) == ("paypal.co.uk", "paypal.co.uk", [], "paypal", "co.uk")
            continue
        h = h.removeprefix("www.") if h.startswith("www.") else h
        if "." not in h or h[0].isdigit():
            assert (got.hostname, got.registrable_domain, got.domain, got.suffix, got.subdomain_labels) == (h, h, h, "", [])
            continue
        k, parts = _suffix_labels(h, rules), h.split(".")
        assert got.suffix == ".".join(parts[-k:]) and got.registrable_domain == ".".join(parts[-k - 1 :])
        assert got.domain == (parts[-k - 1] if len(parts) > k else "") and got.subdomain_labels == parts[: max(0, len(parts) - k - 1)]


# near names


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_near_names(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcé", k=rng.randint(3, 13)))
    words, names = [word() for _ in range(250)] + ["", None, "x" * 4000], [word() for _ in range(120)] + [None, ""]
    names += [w[:3] + "b" + w[3:] for w in words[:40]]
    df = spark.createDataFrame([(w,) for w in words + words[:9]], "word string"), spark.createDataFrame([(w,) for w in names + names[:9]], "name string")
    want = set()
    for w in filter(None, words):
        for n in filter(None, names):
            d = _distance(w, n) if abs(len(w) - len(n)) <= 2 else 9
            letters = len(set(w) & set(n)) / max(len(set(w)), len(set(n)))
            if len(w) >= 5 and len(n) >= 4 and 0 < d <= 2 and d / max(len(w), len(n)) < 0.25 and letters >= 0.5:
                want.add((w, n, d))
    assert len(want) > 50 and {d for *_, d in want} == {1, 2}
    assert _rows(neighbours.near_names(*df), "word", "name", "distance") == sorted(want, key=repr)
    best = {}
    for w, n, d in want:
        best[w] = min(best.get(w, (9, "")), (d, n))
    assert _rows(neighbours.nearest_name(*df), "word", "distance", "name") == sorted(((w, *b) for w, b in best.items()), key=repr)
    assert neighbours.nearest_name(df[0], df[1].limit(0)).collect() == []


# patterns


@pytest.mark.parametrize("block_bytes", [8 << 20, 200])
def test_first_pattern(spark, block_bytes):
    rng = random.Random(5)
    word = lambda k: "".join(rng.choices("abcé ", k=k))
    texts = [word(rng.choice([0, 3, 50, 400])) for _ in range(60)] + [None, ""]
    held = [(word(rng.randint(1, 5)), rng.randint(0, 6), rng.choice(["x", "y", None])) for _ in range(80)] + [("", 0, "none"), (None, 0, "none"), ("a", None, "none")]
    df = spark.createDataFrame(list(enumerate(texts)), "key int, text string").withColumn("label", F.lit("clash"))
    out = {r.key: r for r in patterns.first_pattern(df, spark.createDataFrame(held, "pattern string, priority int, label string"), id_col="key", text_col="text", block_bytes=block_bytes).collect()}
    least = {}
    for p, n, label in held:
        if p and n is not None:
            least[p] = min(least.get(p, (9, True, "")), (n, label is None, label or ""))
    for key, text in enumerate(texts):
        found = sorted((least[p][0], p) for p in least if p in (text or ""))
        got = out[key]
        assert (got.priority, got.pattern, got.n_patterns) == ((*found[0], len(found)) if found else (None, None, 0))
        if found:
            assert got.label == (None if least[found[0][1]][1] else least[found[0][1]][2])
    assert len(out) == len(texts)


def test_repeated_patterns_are_one(spark):
    """However often a pattern is repeated, it goes to the workers once, with the least (priority, label)."""
    held = spark.range(6000).selectExpr("concat('w', id % 3) as pattern", "3 + id % 7 as priority", "case id % 4 when 0 then 'ab' when 1 then 'a' end as label")
    out = patterns.first_pattern(spark.createDataFrame([(1, "w2 w1"), (2, "x")], "key long, text string"), held, id_col="key", text_col="text", block_bytes=1000)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, out.collect())) == [(1, 3, "a", "w1", 2), (2, None, None, None, 0)]


# as-of


@pytest.mark.parametrize("hot", [None, 7])
def test_as_of(spark, hot):
    rng, start = random.Random(6), dt.datetime(2024, 1, 1)
    time = lambda: start + dt.timedelta(seconds=rng.randint(0, 400)) if rng.random() > 0.03 else None
    key = lambda: rng.choice([1, 1, 1, 2, 3, 4, 5, None])
    events = [(i, key(), rng.choice("ab"), time()) for i in range(500)] + [(7, 1, "a", start)] * 3
    records = [(key(), rng.choice("ab"), time(), rng.randint(0, 5)) for _ in range(200)]
    left = spark.createDataFrame(events, "n int, user int, kind string, ts timestamp").withColumn("known_", F.lit(1))
    right = spark.createDataFrame(records, "user int, kind string, ts timestamp, value int")
    out = asof.as_of(left, right, keys=["user", "kind"], event_time="ts", record_time="ts", columns=["value"], hot=hot)
    assert out.columns == [*left.columns, "known"]

    def last(user, kind, ts):
        known = [(t, v) for u, k, t, v in records if (u, k) == (user, kind) and u is not None and t is not None and ts is not None and t <= ts]
        return max(known) if known else None

    got = sorted(((r.n, r.user, r.kind, r.ts, tuple(r.known) if r.known else None) for r in out.collect()), key=repr)
    assert got == sorted(((n, u, k, t, last(u, k, t)) for n, u, k, t in events), key=repr)
    assert asof.as_of(left.limit(0), right, keys=["user", "kind"], event_time="ts", record_time="ts", columns=["value"]).collect() == []


# ranges


def _bits(ip):
    return format(int(ip), f"0{ip.max_prefixlen}b")


def test_address_bits(spark):
    rng = random.Random(7)
    every = [ipaddress.ip_address(rng.getrandbits(32)) for _ in range(60)]
    six = [ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([-1, (1 << 64) - 1, ~((1 << 80) - 1), 0xFFFF])) for _ in range(200)]
    texts = [(str(a), _bits(a)) for a in every + six] + [(a.exploded, _bits(a)) for a in six] + [("::ffff:1.2.3.4", _bits(ipaddress.ip_address("::ffff:1.2.3.4"))), ("fe80::1%eth0", _bits(ipaddress.ip_address("fe80::1"))), ("::", "0" * 128)]
    bad = ["", None, "1.2.3", "1.2.3.256", "g::1", "1:2", ":::"]
    df = spark.createDataFrame([(a,) for a, _ in texts] + [(b,) for b in bad], "a string").withColumn("bits", ranges.address_bits(F.col("a")))
    assert {r.a: r.bits for r in df.collect()} == dict(texts) | dict.fromkeys(bad)


def test_ranges_become_the_least_prefixes(spark):
    rng, rows = random.Random(8), []
    for width, kind in ((32, ipaddress.IPv4Address), (128, ipaddress.IPv6Address)):
        for _ in range(60):
            a = rng.getrandbits(width)
            b = min((1 << width) - 1, a + rng.getrandbits(rng.randint(1, width)))
            rows.append((str(kind(a)), str(kind(b))))
        rows += [(str(kind(0)), str(kind((1 << width) - 1))), (str(kind(5)), str(kind(5))), (str(kind(9)), str(kind(8)))]
    rows += [("1.2.3.4", "::1"), (None, "1.1.1.1")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, first string, last string")
    out = {}
    for r in ranges.prefixes_of(df, "id", first_col="first", last_col="last").collect():
        out.setdefault(r.range_id, set()).add(r.prefix)
    for i, (a, b) in enumerate(rows):
        want = set()
        if a and (":" in a) == (":" in b) and ipaddress.ip_address(a) <= ipaddress.ip_address(b):
            want = {_bits(n.network_address)[: n.prefixlen] for n in ipaddress.summarize_address_range(ipaddress.ip_address(a), ipaddress.ip_address(b))}
        assert out.get(i, set()) == want, (a, b)


def test_longest_prefix(spark):
    rng = random.Random(9)
    networks = [(i, str(ipaddress.ip_network((rng.getrandbits(32), rng.randint(1, 12)), strict=False))) for i in range(80)] + [(99, "2001:db8::/32"), (98, "2001:db8:1::/48"), (97, "2001:db8:1::5"), (96, "1.2.3.0/24"), (95, "1.2.3.0/24"), (94, "no/8"), (93, None), (92, "1.2.3.4/33")]
    addresses = [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(200)] + ["2001:db8::9", "2001:db8:1::9", "2001:db8:1::5", "1.2.3.4", "1.2.3.4", "", None, "x"]
    table = ranges.prefixes_of(spark.createDataFrame(networks, "id int, cidr string"), "id", cidr_col="cidr")
    df = spark.createDataFrame([(a, 1) for a in addresses], "address string, prefix int")
    usable = [(n, ipaddress.ip_network(c)) for n, c in networks if n not in (94, 93, 92)]
    want = []
    for a in addresses:
        met = [(-net.prefixlen, n) for n, net in usable if a and a != "x" and ipaddress.ip_address(a) in net]
        want.append((a, min(met)[1] if met else None, -min(met)[0] if met else None))
    assert sum(w[1] is not None for w in want) > 20
    assert _rows(ranges.covering(df, table), "address", "range_id", "prefix_length") == sorted(want, key=repr)


# chains


@pytest.mark.parametrize("cap", [1, 2, 7, 10, 16])
def test_followed_chains(spark, cap):
    rng = random.Random(cap)
    edges = [(f"u{rng.randrange(60)}", f"u{rng.randrange(60)}", rng.randrange(9)) for _ in range(90)] + [(f"line{k}", f"line{k + 1}", 0) for k in range(20)] + [(f"hot{k}", "line0", 0) for k in range(200)] + [("self", "self", 0), (None, "x", 0), ("x", None, 0)]
    step = {}
    for url, target, ord_ in edges:
        if url and target and url != target:
            step[url] = min(step.get(url, (99, "")), (ord_, target))
    want = []
    for url in step:
        chain = [url]
        while len(chain) < cap and chain[-1] in step and step[chain[-1]][1] not in chain:
            chain.append(step[chain[-1]][1])
        ahead = step[chain[-1]][1] if chain[-1] in step else None
        want.append((url, chain, chain[-1], len(chain) - 1, ahead in chain, ahead is not None and ahead not in chain))
    out = redirects.followed_chains(spark.createDataFrame(edges, "url string, target string, ord int"), cap)
    assert _rows(out, "url", "chain", "final_url", "n_hops", "cyclic", "capped") == sorted(want, key=repr)


def test_joins_meet_by_equality(spark):
    """No plan of these queries compares every row with every other one."""
    from indicata.plans import joins

    for name, query in joins.QUERIES.items():
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
