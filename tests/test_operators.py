"""Mail, artifacts, files, redirects, lookup and call accounting on small cases."""

import io
import json
import zipfile
import zlib

from pyspark.sql import functions as F

from indicata.operators import artifacts, display, mail, redirects
from indicata.plans import lookup, risk
from indicata.sources import decoders, tables
from indicata.streaming import calls

MESSAGE = """Received: from inner.protection.outlook.com (x [10.0.0.9]) by last.protection.outlook.com; Mon, 1 Jan 2024 00:00:04 +0000
Received: from mx.protection.outlook.com (mx [40.1.1.1]) by next.protection.outlook.com; Mon, 1 Jan 2024 00:00:03 +0000
Received: from mail.shop.com (mail.shop.com [9.9.9.9]) by mx.protection.outlook.com;
 Mon, 1 Jan 2024 00:00:01 +0000
From: "Shop, Inc" <News@Shop.com>
Subject: hello
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=b

--b
Content-Type: text/html; charset=utf-8

<a href="https://nam1.safelinks.protection.outlook.com/?url=https%3A%2F%2Fevil.com%2Flogin">www.paypal.com</a> http://a.example.net/p. 8.8.4.4 10.0.0.1
--b
Content-Type: text/plain

see mail.foo-bar.com and http://b.io/x) and https://b.io/x and logo.png
--b
Content-Type: text/calendar; name=i.ics
Content-Disposition: attachment; filename=i.ics

BEGIN:VEVENT
URL:https://ics.example.net/a
DESCRIPTION:join at https://meet.io/1, or not
SUMMARY:https://no.io
--b--
"""


def messages(spark):
    return decoders.messages(spark.createDataFrame([(1, MESSAGE), (2, ""), (3, None), (4, "garbage without any header")], "msg_id long, raw string"))


def test_message(spark):
    got = {r.msg_id: r for r in messages(spark).collect()}
    assert [p.filename for p in got[1].parts] == ["i.ics"] and "foo-bar" in got[1].plain_text and "evil.com" in got[1].html_text
    assert got[2].parts == got[3].parts == []


def test_repeated_internal_hop_goes(spark):
    got = {r.msg_id: r for r in mail.with_transport(messages(spark)).collect()}
    assert [h.sending_host for h in got[1].hops] == ["mail.shop.com", "mx.protection.outlook.com"]
    assert got[1].origin.ip == "9.9.9.9" and got[1].final_hop.sending_host == "mx.protection.outlook.com" and got[2].origin is None
    ips = {r.msg_id: r.x for r in messages(spark).select("msg_id", mail.received_ips(F.col("headers")).alias("x")).collect()}
    assert ips[1] == ["10.0.0.9", "40.1.1.1", "9.9.9.9"]


def test_gateway_keys(spark):
    df = spark.createDataFrame([("Proofpoint",), ("Microsoft 365",), ("  MIMECAST ",), ("trend micro",), ("unknown gw",)], "n string")
    assert [r.k for r in df.select(mail.gateway_key(F.col("n")).alias("k")).collect()] == ["proofpoint", "microsoft", "mimecast", "trendmicro", "unknown gw"]


def test_artifacts(spark):
    got = {r.msg_id: r for r in artifacts.extract(messages(spark), id_col="msg_id", text_col="plain_text", html_col="html_text").collect()}
    assert {u.url for u in got[1].urls} == {"http://b.io/x", "https://b.io/x", "http://a.example.net/p", "https://evil.com/login"}
    assert {u.gateway for u in got[1].urls if u.original != u.url} == {"Microsoft SafeLinks"}
    assert got[1].domains == ["mail.foo-bar.com"] and got[1].ips == ["8.8.4.4"] and got[2].urls == []


def test_many_urls_overflow(spark):
    df = spark.createDataFrame([(1, " ".join(f"https://h{k}.com/{k}" for k in range(14)))], "doc_id long, text string")
    shown = [u.displayed for u in artifacts.extract(df).first().urls]
    assert shown == [True] * 10 + [False] * 4


def test_links_and_invitations(spark):
    rows = artifacts.link_mismatches(decoders.anchors(messages(spark))).collect()
    assert [(r.display_domain, r.href_domain, r.unwrapped_href) for r in rows] == [("www.paypal.com", "evil.com", "https://evil.com/login")]
    ics = messages(spark).where("msg_id = 1").select(artifacts.ics_urls(F.decode(F.col("parts")[0]["payload"], "UTF-8")).alias("u")).first().u
    assert ics == ["https://ics.example.net/a", "https://meet.io/1"]
    assert [r.filename for r in artifacts.attachments(messages(spark)).collect()] == ["i.ics"]


def test_priority_of_sources(spark):
    body = spark.createDataFrame([(1, "u"), (1, "v"), (2, "u")], "msg_id long, ioc string")
    qr = spark.createDataFrame([(1, "u"), (1, "u"), (3, "v")], "msg_id long, ioc string")
    assert {tuple(r) for r in artifacts.without(body, qr).collect()} == {(1, "v"), (2, "u")}


def test_qr_types(spark):
    df = spark.createDataFrame([("http://a.b",), ("upi://a.b",), ("data:x.y",), ("plain",), ("a.com",)], "p string")
    assert [r.t for r in df.select(artifacts.qr_type(F.col("p")).alias("t")).collect()] == ["url", "domain", None, None, "domain"]


def _docx():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>Visit www.doc-site.com now</w:t></w:p>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Target="https://rel.io/x." TargetMode="External"/><Relationship Target="https://in.io" /></Relationships>')
    return buffer.getvalue()


def _pdf():
    content = zlib.compress(b"BT (See http://shown.io/a) Tj [(ww) 3 (w.split.com)] TJ ET")
    return b"%PDF-1.4 /A << /URI (https://link.io/\\(x\\)) >>\nstream\n" + content + b"\nendstream"


def test_files(spark):
    files = [("a.docx", "", _docx()), ("b.pdf", "application/pdf", _pdf()), ("c.html", "text/html", b"<html><img src='https://img.io/p'> https://t.io/1</html>"), ("d.txt", "", b"go to www.site.org/x and a.png"), ("e.bin", "", b"\xff\xfehttps://bin.io/zz"), ("f.docx", "", b"not a zip"), ("g.png", "image/png", b""), ("h.txt", None, None)]
    got = {r.filename: r for r in decoders.files(spark.createDataFrame(files, "filename string, content_type string, payload binary"), artifacts.NOISE_TLDS).collect()}
    assert got["a.docx"].urls == ["https://rel.io/x", "www.doc-site.com"] and got["a.docx"].extractor == "office"
    assert {"https://link.io/(x)", "http://shown.io/a", "www.split.com"} <= set(got["b.pdf"].urls)
    assert got["c.html"].urls == ["https://img.io/p", "https://t.io/1"] and got["d.txt"].urls == ["www.site.org/x"] and got["e.bin"].urls == ["https://bin.io/zz"]
    assert got["f.docx"].urls == got["g.png"].urls == got["h.txt"].urls == []
    assert decoders.carved_images(b"xx\xff\xd8\xff12\xff\xd9yy\x89PNG\r\n\x1a\nIEND12345678") == [b"\xff\xd8\xff12\xff\xd9", b"\x89PNG\r\n\x1a\nIEND12345678"]


def test_sources(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([" B ", "a", None, "b", ""]))
    (tmp_path / "o.json").write_text(json.dumps({"items": ["X"]}))
    (tmp_path / "bad.json").write_text("{")
    assert tables.list_values(spark, str(tmp_path / "l.json")) == ("b", "a") and tables.list_values(spark, str(tmp_path / "o.json"), "items") == ("x",)
    assert tables.list_values(spark, str(tmp_path / "bad.json")) == tables.list_values(spark, str(tmp_path / "none.json")) == ()
    (tmp_path / "m.eml").write_text(MESSAGE)
    (tmp_path / "n.exe").write_text("x")
    (tmp_path / "big.txt").write_bytes(b"x" * 100)
    assert [r.raw[:8] for r in tables.mail_files(spark, str(tmp_path)).collect()] == [b"Received"]
    assert {r.filename for r in tables.uploaded_files(spark, str(tmp_path), max_bytes=50).collect()} == set()
    assert {r.filename for r in tables.uploaded_files(spark, str(tmp_path)).collect()} == {"m.eml", "big.txt"}
    pasted = tables.pasted(spark.createDataFrame([(" a.com \nnope\n\n1.2.3.4\n",)], "text string")).collect()
    assert [(r.pos, r.raw) for r in pasted] == [(0, "a.com"), (3, "1.2.3.4")]
    assert json.loads(tables.as_json(spark.sql("select 1 as a, 'x' as b")).first().value) == {"a": 1, "b": "x"}


FEEDS = {
    "vt": [("bad.xyz", 12, 0, 50, 4, 1, False, None), ("https://u.com/a", 3, 0, 9, 9, 5, False, None), ("u.com", 3, 0, 9, 9, None, False, None), ("err.com", None, None, None, None, None, None, "timeout"), ("9.9.9.9", 6, 0, 1, 1, 1, False, None), ("d41d8cd98f00b204e9800998ecf8427e", 30, 0, 10, 20, 1, False, None)],
    "otx": [("9.9.9.9", 7, ["Emotet", "Hive"], ["botnet"], [], 0, None, 0, 0, None, "AS1 Vultr", None), ("bad.xyz", 2, [], ["phishing"], [], 1, 10, 0, 0, None, None, None)],
    "whois": [("bad.xyz", 5)], "tls": [("bad.xyz", 3, "LE", "R3", None)], "abuseipdb": [("9.9.9.9", 80, False, None)],
}


def feeds(spark):
    return {k: spark.createDataFrame(v, lookup.SCHEMAS[k]) for k, v in FEEDS.items()}


def test_lookup_with_feeds(spark):
    names = ["bad.xyz", "https://u.com/a", "err.com", "9.9.9.9", "d41d8cd98f00b204e9800998ecf8427e", "", "???", "bad.xyz"]
    out = lookup.lookup(spark.createDataFrame(list(enumerate(names)), "row_id long, raw string"), feeds(spark)).collect()
    got = {r.row_id: r for r in out}
    assert len(out) == len(names) and got[0].factors == got[7].factors
    points = {k: {f.key: f.points for f in r.factors or []} for k, r in got.items()}
    assert points[0] == {"vt_domain_high": 45, "young_domain": 30, "tls_very_new": 10, "otx_strong": 20, "otx_vt_correlation": 10, "vt_otx_corroboration": 15, "tld_high_risk": 15, "tld_high_corr": 10, "behavioral_pattern_detected": 10}
    assert got[0].raw_score == 165 and got[0].normalized_score == 100 and got[0].verdict == "HIGHLY MALICIOUS"
    assert points[1]["vt_domain_low"] == 25 and got[1].virustotal.source == "domain" and got[1].virustotal.last_seen == 5
    assert points[2] == {} and got[2].severity == "LOW"
    assert points[3] == {"vt_high_detection": 40, "abuse_high_band": 30, "asn_abuse_context": 8, "otx_suspicious": 10, "otx_ip_malware": 20, "otx_ip_pulses": 10, "malware_infrastructure_confirmed": 20, "ransomware_infrastructure": 15, "otx_vt_correlation": 10, "cloud_abuse_pattern": 10, "multi_feed_consensus": 15}
    assert got[4].raw_score == 80 and got[4].severity == "HIGH"
    assert got[5].error == "Empty query" and got[6].error == "Unrecognised input type" and got[5].factors is None


def test_bulk_equals_single(spark):
    names = ["bad.xyz", "https://u.com/a", "9.9.9.9"]
    many = {r.raw: r.raw_score for r in lookup.lookup(spark.createDataFrame([(n,) for n in names], "raw string"), feeds(spark)).collect()}
    one = lookup.lookup(spark.createDataFrame([(names[0],)], "raw string"), feeds(spark)).first()
    assert one.raw_score == many[names[0]]


def test_score_of_bare_rows(spark):
    out = risk.score(spark.createDataFrame([("domain",), ("hash",), ("ip",), (None,)], "input_type string")).collect()
    assert {(r.raw_score, r.severity, len(r.factors)) for r in out} == {(0, "LOW", 0)}
    shown = risk.score(spark.createDataFrame([("domain", True, 20, "High")], "input_type string, vt_ok boolean, vt_malicious int, tld_level string")).select(risk.factor_breakdown(F.col("factors")).alias("b")).first().b
    assert [(x.key, x.points, x.percent, x.weight) for x in shown] == [("vt_domain_critical", 55, 100, "high"), ("tld_high_risk", 15, 100, "high")]


def test_elevation(spark):
    urls = spark.createDataFrame([(0, "https://a.com/1", 40, "MEDIUM", "x"), (1, "https://a.com/2", 30, "MEDIUM", "x"), (2, "https://low.com/", 20, "LOW", "x"), (3, "https://none.com/", 90, "HIGH", "x")], "pos int, ioc string, score int, severity string, verdict string")
    verdicts = spark.createDataFrame([("https://a.com/1", True, True, 75, ["a.com", "end.com"]), ("https://low.com/", True, True, 99, ["low.com", "end.com"])], "url string, has_redirects boolean, chain_suspicious boolean, final_score int, domains array<string>")
    out = redirects.elevated(urls, verdicts)
    got = {r.pos: r for r in out.collect()}
    assert [(got[k].score, got[k].severity, got[k].verdict) for k in range(4)] == [(75, "HIGH", "LIKELY MALICIOUS"), (75, "HIGH", "LIKELY MALICIOUS"), (20, "LOW", "x"), (90, "HIGH", "x")]
    assert got[1].elevation.points == 45 and got[2].elevation is None
    assert redirects.redirect_summary(out).first()[:] == (2, 1, 4, 2)


def test_badges_and_scores(spark):
    df = spark.createDataFrame([(1, 0, "a", "Email Body", 10, "LOW", "url"), (1, 1, "b", "QR", 70, "HIGH", "url"), (1, 2, "c", "QR", 70, "HIGH", "ip")], "msg_id long, pos int, ioc string, source string, score int, severity string, ioc_type string")
    assert mail.message_scores(df).first()[:] == (1, 70, "HIGH", "b", 2, 0)
    assert {(r.source, r.n_high, r.worst) for r in display.source_badges(df).collect()} == {("Email Body", 0, "LOW"), ("QR", 2, "HIGH")}
    counts = display.artifact_total(artifacts.artifact_counts(df)).first()
    assert counts.total_artifacts == 3 and counts.total_high == 2


def _log(spark, folder):
    rows = [("2024-01-01 00:00:10", "s1", "otx", "GET", False), ("2024-01-01 00:00:50", "s1", "violation", "POST", True), ("2024-01-01 00:01:30", "s2", "otx", "GET", False)]
    spark.createDataFrame(rows, "ts string, session_id string, api string, method string, violation boolean").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(folder)
    return spark.readStream.schema(tables.CALLS).parquet(folder)


def test_streaming_windows(spark, tmp_path):
    stream = calls.windowed_counts(_log(spark, str(tmp_path / "in")), "1 minute")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r.start.minute, r.api, r.calls, r.violations) for r in spark.sql("select * from w").collect()} == {(0, "otx", 1, 0), (0, "violation", 1, 1), (1, "otx", 1, 0)}


def test_streaming_sessions(spark, tmp_path):
    stream = calls.session_totals(_log(spark, str(tmp_path / "in")))
    query = stream.writeStream.outputMode("update").format("memory").queryName("s").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r.session_id, r.total, r.violations) for r in spark.sql("select * from s where not expired").collect()} == {("s1", 2, 1), ("s2", 1, 0)}


def test_newest_record_of_a_feed(spark):
    rows = [("9.9.9.9", 80, False, None, 1), ("9.9.9.9", 10, False, None, 3), ("9.9.9.9", None, None, "timeout", 3), ("9.9.9.9", 60, False, None, 2), (None, 99, True, None, 9)]
    schema = lookup.SCHEMAS["abuseipdb"] + ", as_of int"
    asked = spark.createDataFrame([("9.9.9.9",), ("",), ("a.com",), ("a.com",)], "raw string")
    for order in (rows, rows[::-1]):
        out = lookup.lookup(asked, {"abuseipdb": spark.createDataFrame(order, schema)}).collect()
        assert [r.abuse.abuse_confidence_score for r in out if r.raw == "9.9.9.9"] == [10] and len(out) == 4
        assert all(r.abuse is None for r in out if r.raw != "9.9.9.9")


def test_calls_without_a_session(spark):
    rows = [("2024-01-01 00:00:01", None), ("2024-01-01 00:00:03", None), ("2024-01-01 00:00:05", "s")]
    log = spark.createDataFrame(rows, "ts string, session_id string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.session_id or "", r.t) for r in calls.session_timeline(log).collect()) == [("", 0.0), ("", 2.0), ("s", 0.0)]


def test_archives_are_bounded():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(5):
            z.writestr(f"word/{k}.xml", "x" * 1000)
    assert [len(d) for _, d in decoders._members(buffer.getvalue(), 2500)] == [1000, 1000, 500]
