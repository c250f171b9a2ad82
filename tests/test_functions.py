"""Scalar functions against plain Python on worked cases and random strings."""

import ipaddress
import math
import random
from collections import Counter
from urllib.parse import parse_qsl, unquote, urlsplit

import pytest
from pyspark.sql import functions as F

from indicata import lists
from indicata.functions import brands, hosts, infra, intel, text, urls


def values(spark, items, expression, kind="string"):
    rows = spark.createDataFrame(list(enumerate(items)), f"i int, x {kind}").select("i", expression(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def test_addresses(spark):
    items = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "::", "::1", "1::", "2001:db8::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "fe80::1%eth0", "12345::", "g::", ":1", "1:", "1.2.3.4/8", "1.2.3.4/33", "1.2.3.4/255.255.255.0", "1.2.3.4/255.0.255.0", "1.2.3.4/0.0.0.255", "::/0", "::/129", "2001:db8::/32", "1.2.3.4/", "10.0.0.1/024"]
    rng = random.Random(1)
    items += [":".join(rng.choice(["", "1", "ab", "ffff", "0", "1.2.3.4"]) for _ in range(rng.randrange(2, 10))) for _ in range(400)]

    def want(x):
        for parse in (ipaddress.ip_address, lambda v: ipaddress.ip_network(v, strict=False)):
            try:
                parse(x)
                return True
            except ValueError:
                pass
        return False

    got = values(spark, items, lambda x: text.is_ip_literal(x) | text.is_cidr(x))
    assert [(x, g) for x, g in zip(items, got)] == [(x, want(x)) for x in items]


def test_entropy(spark):
    items = ["", "a", "ab", "aabb", "xk3jm9a", "paypal", "éüé"]
    want = [-sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0 for s in items]
    assert values(spark, items, text.shannon_entropy) == pytest.approx(want)


def test_rounding_is_half_even_on_ties(spark):
    assert values(spark, [2.125, 2.375, 0.125, 3.1], text.round2, "double") == [2.12, 2.38, 0.12, 3.1]


def test_homoglyph_form(spark):
    rng = random.Random(2)
    items = ["".join(rng.choice("abceilmnorsvwz0123456@-") for _ in range(rng.randrange(12))) for _ in range(300)]
    assert values(spark, items, text.homoglyph_form) == [text.homoglyph_text(x) for x in items]
    assert text.homoglyph_text("paypa1") == text.homoglyph_text("paypal") and text.homoglyph_text("arnazon") == text.homoglyph_text("amazon")


def test_lists_are_whole():
    assert [len(x) for x in (lists.BRANDS, lists.LURES, lists.CDNS, lists.ABUSED_HOSTING, lists.SAFE_TLDS, lists.MEDIUM_TLDS, lists.TWO_LABEL_SUFFIXES, lists.TLD_TWO_LABEL_SUFFIXES)] == [122, 189, 24, 47, 82, 25, 176, 49]


def test_tokens(spark):
    items = ["cloudflare-okta.com", "paypal-login.fastly.net", "PAYPAL.COM", "a--b.evil.io", "paypal.paypal.com", "", None]
    assert values(spark, items, text.tokens) == [["cloudflare", "okta", "com"], ["paypal", "login", "fastly", "net"], ["paypal", "com"], ["a", "b", "evil", "io"], ["paypal", "com"], [], []]


def test_url_parts(spark):
    items = ["https://User:pw@Host.COM:8080/a/b;p?q=1&r=%20#f", "http://[2001:DB8::1]:80/x", "mailto:a@b", "//host/p", "no scheme", "http://a|b/%zz?x", "ftp://h/p;t=i", "http://h?x/y", "http://h#f?x", "HTTP://x_y.com/", ""]
    got = values(spark, items, urls.url_parts)
    for x, g in zip(items, got):
        p = urlsplit(x)
        path = p.path
        if p.scheme in ("http", "https", "ftp", ""):
            head, _, tail = path.rpartition("/")
            path = path[: len(path) - len(tail)] + tail.split(";")[0]
        assert (g.scheme, g.netloc, g.hostname, g.path, g.query) == (p.scheme, p.netloc, p.hostname or "", path, p.query), x


def test_queries_and_decoding(spark):
    items = ["a=1&b=%20x+y&c&d=", "", "a=b=c&&é=%C3%A9", "x=%zz&y=%4"]
    got = values(spark, items, urls.query_pairs)
    assert [[(p["name"], p["value"]) for p in g] for g in got] == [parse_qsl(x, keep_blank_values=True) for x in items]
    odd = ["%41%zz%4", "a+b%2Bc", "%C3%A9", "plain", "100%"]
    assert values(spark, odd, text.percent_decoded) == [unquote(x) for x in odd]


def test_host_examples(spark):
    got = values(spark, ["pacificacompanies.co.in", "login-secure.paypal.com", "www.paypal.com", "cafe", "1.2.3.4", "a..b.com", "", None], hosts.host_context)
    assert [(g.hostname, g.registrable_domain, g.subdomain_labels, g.domain, g.suffix) for g in got] == [
        ("pacificacompanies.co.in", "pacificacompanies.co.in", [], "pacificacompanies", "co.in"), ("login-secure.paypal.com", "paypal.com", ["login-secure"], "paypal", "com"), ("paypal.com", "paypal.com", [], "paypal", "com"),
        ("cafe", "cafe", [], "cafe", ""), ("1.2.3.4", "1.2.3.4", [], "1.2.3.4", ""), ("a..b.com", "b.com", ["a"], "b", "com"), ("", "", [], "", ""), ("", "", [], "", ""),
    ]


def test_host_suffixes(spark):
    assert values(spark, ["a.b.c", "c"], hosts.host_suffixes) == [["a.b.c", "b.c", "c"], ["c"]]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_brand_similarity_on_random_names(spark):
    rng = random.Random(3)
    names = []
    for _ in range(120):
        b = list(rng.choice(lists.BRANDS))
        for _ in range(rng.randrange(3)):
            b[rng.randrange(len(b))] = rng.choice("abcl1o0")
        names.append("".join(b) + rng.choice(["", "-login", "-" + rng.choice(lists.BRANDS)]) + ".com")

    def want(domain):
        parts = [p for p in domain.split(".")[0].replace("_", "-").split("-") if p]
        for t in parts:
            for b in lists.BRANDS:
                if t == b and len(parts) > 1 or t != b and text.homoglyph_text(t) == text.homoglyph_text(b):
                    return b, "High"
        best = None
        for i, t in enumerate(parts):
            if t in lists.INFRA_TOKENS or len(t) < 5:
                continue
            for o, b in enumerate(lists.BRANDS):
                d = _distance(t, b)
                if t != b and len(b) >= 4 and len(set(t) & set(b)) / max(len(set(t)), len(set(b))) >= 0.5 and d / max(len(t), len(b)) < 0.25:
                    best = min(best or (99,), (d, i, o, b))
        if best and best[0] in (1, 2) and len(parts[0]) >= len(best[3]) - 1 and (best[0] == 2 or len(parts[0]) >= 3):
            return best[3], "High" if best[0] == 1 else "Medium"
        return None, None

    got = values(spark, names, brands.brand_similarity)
    assert [(n, g.matched_brand, g.confidence) for n, g in zip(names, got)] == [(n, *want(n)) for n in names]


def test_merged_chain(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "x", "c", "y"]), (2, ["a", "b"], ["a", "c"]), (3, [], ["q"]), (4, ["q"], []), (5, [str(k) for k in range(12)], ["z"])], "i int, v array<string>, u array<string>")
    got = {r.i: r.m for r in df.select("i", urls.merged_chain(F.col("v"), F.col("u")).alias("m")).collect()}
    assert got == {1: ["a", "b", "x", "c", "y"], 2: ["a", "b", "c"], 3: ["q"], 4: ["q"], 5: [str(k) for k in range(10)]}


def test_infrastructure_order(spark):
    rows = spark.createDataFrame([("x.pages.dev", ["y.netlify.app"], "AWS", "Amazon"), ("x.com", ["y.netlify.app."], "AWS", "Amazon"), ("x.com", [], "FASTLY", "Amazon"), ("1.1.1.1", [], "FASTLY", "Amazon"), ("x.com", None, " Tiny ", None)], "h string, c array<string>, o string, t string")
    none = F.lit(None).cast("string")
    got = [r.p for r in rows.select(infra.infrastructure(F.col("h"), F.col("c"), F.col("o"), F.col("t"), none, none)["provider"].alias("p")).collect()]
    assert got == ["Cloudflare Pages", "Netlify", "AWS CloudFront", "Fastly", "Tiny"]


def test_age_rounds_down(spark):
    df = spark.sql("select timestamp '2024-01-02 12:00:00' a, timestamp '2024-01-01 13:00:00' b")
    assert df.select(intel.age_days(F.col("b"), F.col("a")), intel.age_days(F.col("a"), F.col("b"))).first()[:] == (0, -1)


def test_keys_and_markup(spark):
    assert values(spark, [None, "", "12345678", "abcd1234efgh"], text.masked_key) == ["", "", "•" * 8, "abcd••••efgh"]
    assert values(spark, ["<a href=\"x\">&'</a>"], text.escape_html) == ["&lt;a href=&quot;x&quot;&gt;&amp;'&lt;/a&gt;"]
    assert values(spark, ["https://x.com/" + "é" * 60], intel.url_id)[0].isascii()
