"""Small input tables that no data folder holds, as SQL text for any engine."""

from __future__ import annotations


def literal(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def values_sql(columns: str, rows) -> str:
    """``select * from (values ...)`` with the given column names."""
    return f"select * from (values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) as t({columns})"


INPUTS = values_sql("row_id, raw", [
    (1, ""), (2, "  8.8.8.8 "), (3, "2001:db8::1"), (4, "10.0.0.0/8"), (5, "d41d8cd98f00b204e9800998ecf8427e"), (6, "da39a3ee5e6b4b0d3255bfef95601890afd80709"),
    (7, "E3B0C44298FC1C149AFBF4C8996FB92427AE41E4649B934CA495991B7852B855"), (8, "HTTP://a.com/x"), (9, "https://b.org"), (10, "ftp://c.net/f"), (11, "javascript:alert(1)"), (12, "bare"),
    (13, "a" * 63 + ".com"), (14, "a" * 64 + ".com"), (15, "trailing.dot.com."), (16, "256.1.1.1"), (17, "1.2.3.4/33"), (18, "x" * 600), (19, "::1"), (20, "sub-domain.example.co.uk"),
    (21, "-bad.com"), (22, "bad-.com"), (23, "1.2.3"), (24, "http:/one-slash.com"), (25, "a_b.com"),
])

HOSTS = values_sql("host_id, host", [
    (1, "pacificacompanies.co.in"), (2, "login-secure.paypal.com"), (3, "www.paypal.com"), (4, "cloudflare-okta.com"), (5, "paypal.paypal.com"), (6, "a--b.evil.io"),
    (7, "example.co.in"), (8, "phish.xyz"), (9, "spam.info"), (10, "xk3jm9a.evil.com"), (11, "keepass-info.global.ssl.fastly.net"), (12, "paypal.co.uk"), (13, "shop.myapp.app"), (14, "view.x.sites.google.com"),
    (15, "p1nterest.com"), (16, "arnazon.com"), (17, "paypall.com"), (18, "cafe"), (19, "[2001:db8::1]"), (20, "1.2.3.4"), (21, "HTTP://User.Example.COM:8080/path"), (22, "micros0ft-login.com"), (23, "secure-verify-account.netlify.app"),
    (24, "paypal-login.fastly.net"), (25, "mail.google.com"), (26, "amazom.net"), (27, "a.b.c.d.evil.co.ke"), (28, "netfIix.com"), (29, "drive.storage.googleapis.com"), (30, "x.github.io"),
    (31, "dropbox-files.web.app"), (32, "faceboook.com"), (33, "linkedln.com"), (34, "sub.whatsap.evil.org"), (35, "qwertyuiopasdfgh.biz"), (36, "aabbccddeeffgg.top"), (37, "okta"), (38, "mic-rosoft.com"), (39, "update.chase.secure.evil.ru"), (40, "office365-portal.azureedge.net"),
])

URLS = values_sql("url_id, url", [
    (1, "https://evil.com/login/verify/account"), (2, "http://1.2.3.4/a"), (3, "ftp://x.org/f"), (4, "https://a.com/" + "x" * 119), (5, "https://a.com/" + "x" * 120), (6, "https://a.com/" + "x" * 299), (7, "https://a.com/" + "y" * 300),
    (8, "https://a.com/%41%42%43%44?q=1"), (9, "https://a.com/?d=" + "QUJD" * 9 + "=="), (10, "https://a.com/?redirect=x&y=2"), (11, "https://a.com//evil.com/x"), (12, "https://a.com/paypal.com/login"),
    (13, "https://a.com/" + "0123456789abcdef" * 2), (14, "https://a.com/?u=http://b.com"), (15, "https://a.com/?x=1&u=http://b.com"), (16, "https://a.com/?x=1?next=https://b.com"), (17, "https://a.com/wp-admin;x=1"), (18, "https://A.COM:8443/Secure?Session=1"),
    (19, "https://user@host.com/"), (20, "https://a.com"), (21, "https://a.com/logins/updater"), (22, "https://a.com/?URL=1"),
])

MAILS = values_sql("msg_id, pos, name, value", [
    (1, 1, "Received", "from relay.protection.outlook.com (relay.protection.outlook.com [40.1.1.1]) by mx.corp.com; Mon, 1 Jan 2024 00:00:03 +0000"),
    (1, 2, "Received", "from inner.protection.outlook.com (x [10.0.0.5]) by y.protection.outlook.com; Mon, 1 Jan 2024 00:00:02 +0000"),
    (1, 3, "Received", "from mx1.pphosted.com (mx1.pphosted.com [143.55.149.216]) by z.protection.outlook.com; Mon, 1 Jan 2024 00:00:01 +0000"),
    (1, 4, "Received", "from a27.us-west-2.amazonses.com (a27 [54.240.27.57]) by mx1.pphosted.com; Mon, 1 Jan 2024 00:00:00 +0000"),
    (1, 5, "Authentication-Results", "spf=fail (sender IP is 143.55.149.216) smtp.mailfrom=us-west-2.amazonses.com; dkim=pass header.d=shop.com; dmarc=pass header.from=shop.com"),
    (1, 6, "ARC-Seal", "i=1; a=rsa-sha256; d=microsoft.com; s=arcselector; cv=none"),
    (1, 7, "ARC-Authentication-Results", "i=1; mx.microsoft.com 1; spf=fail; dkim=pass header.d=shop.com; dmarc=pass"),
    (1, 8, "From", '"Shop" <News@shop.com>'), (1, 9, "Return-Path", "<b@us-west-2.amazonses.com>"), (1, 10, "Reply-To", "help@evil.org"),
    (2, 1, "Received", "from mail.sender.net (mail.sender.net [9.9.9.9]) by mx1.example.org; Tue, 2 Jan 2024 00:00:00 +0000"),
    (2, 2, "Authentication-Results", "mx1.example.org; spf=softfail smtp.mailfrom=bounce@sender.net; dkim=fail header.d=other.net; dmarc=fail header.from=bank.com"),
    (2, 3, "From", "security@bank.com"), (2, 4, "Return-Path", "<bounce@sender.net>"),
    (3, 1, "Authentication-Results-Original", "mx1.pphosted.com; spf=pass smtp.mailfrom=x@a.com; dkim=none"), (3, 2, "Authentication-Results", "mx.google.com; spf=fail; dkim=pass header.d=a.com; dmarc=pass"), (3, 3, "From", "x@a.com"),
    (4, 1, "Received-SPF", "pass (mailfrom) identity=x"), (4, 2, "From", "only@spf.com"), (5, 1, "Subject", "nothing"),
    (6, 1, "ARC-Seal", "i=2; d=google.com; s=x; cv=pass"), (6, 2, "ARC-Authentication-Results", "i=2; mx.google.com; spf=pass; dkim=pass; dmarc=pass"), (6, 3, "Authentication-Results", "mx.unknown.org; spf=pass; dkim=none"), (6, 4, "From", "a@b.c"),
])

#: (msg_id, origin, hops, spf, dkim, dmarc, source_type, chain_valid, trusted_instance, from_domain, bulk_sender, mismatches, n_anomalies), worked out by hand.
MAIL_RESULTS = values_sql("msg_id, origin, n_hops, spf, dkim, dmarc, source_type, chain_valid, trusted_instance, from_domain, bulk_sender, mismatches, n_anomalies", [
    (1, "a27.us-west-2.amazonses.com", 4, "fail", "pass", "pass", "arc", True, 1, "shop.com", "Amazon SES", "smtp.mailfrom=us-west-2.amazonses.com/info|Return-Path=us-west-2.amazonses.com/info|Reply-To=evil.org/high", 2),
    (2, "mail.sender.net", 1, "softfail", "fail", "fail", "fallback", False, None, "bank.com", "", "smtp.mailfrom=sender.net/high|Return-Path=sender.net/high|DKIM signing domain=other.net/medium", 5),
    (3, None, 0, "pass", "none", "none", "original", False, None, "a.com", "", "", 0),
    (4, None, 0, "pass", "none", "none", "none", False, None, "spf.com", "", "", 1),
    (5, None, 0, "none", "none", "none", "none", False, None, "", "", "", 1),
    (6, None, 0, "pass", "none", "none", "fallback", False, 2, "b.c", "", "", 0),
])

#: Columns and records of feed snapshots, and the indicators that meet them; templates, whose results were worked out by hand from the rules.
FEEDS = {
    "vt": ("ioc, malicious, suspicious, harmless, undetected, last_seen, not_found, error", (
        ("bad.xyz", 12, 0, 50, 4, 1, False, None),
        ("https://u.com/a", 3, 0, 9, 9, 5, False, None),
        ("u.com", 3, 0, 9, 9, None, False, None),
        ("err.com", None, None, None, None, None, None, "timeout"),
        ("9.9.9.9", 6, 0, 1, 1, 1, False, None),
        ("d41d8cd98f00b204e9800998ecf8427e", 30, 0, 10, 20, 1, False, None),
        ("paypal-verify.netlify.app", 1, 0, 60, 5, 1, False, None),
    )),
    "otx": ("ioc, pulse_count, families, tags, malware_count, recent_activity_days, passive_dns_count, unique_ip_count, asn", (
        ("9.9.9.9", 7, "Emotet,Hive", "botnet", 0, None, 0, 0, "AS1 Vultr"),
        ("bad.xyz", 2, "", "phishing", 1, 10, 0, 0, None),
        ("d41d8cd98f00b204e9800998ecf8427e", 5, "Emotet", "trojan", 0, None, 0, 0, None),
        ("old.com", 4, "", "", 3, None, 0, 0, None),
    )),
    "whois": ("domain, age_days", (
        ("bad.xyz", 5),
        ("old.com", 5000),
    )),
    "tls": ("host, tls_age_days, issuer, issuer_cn, error", (
        ("bad.xyz", 3, "LE", "R3", None),
        ("u.com", None, None, None, "refused"),
    )),
    "abuseipdb": ("ip, abuse_confidence_score, is_tor, error", (
        ("9.9.9.9", 80, False, None),
        ("8.8.4.4", 10, True, None),
    )),
}
FEED_ROWS = (
    # row, raw, raw score, severity, verdict, factors, error
    (1, "bad.xyz", 165, "HIGH", "HIGHLY MALICIOUS", 9, None), (2, "https://u.com/a", 25, "LOW", "LOW THREAT", 1, None), (3, "err.com", 0, "LOW", "LOW THREAT", 0, None), (4, "9.9.9.9", 188, "HIGH", "HIGHLY MALICIOUS", 11, None),
    (5, "D41D8CD98F00B204E9800998ECF8427E", 100, "HIGH", "HIGHLY MALICIOUS", 5, None), (6, "paypal-verify.netlify.app", 131, "HIGH", "HIGHLY MALICIOUS", 11, None), (7, "8.8.4.4", 25, "LOW", "LOW THREAT", 2, None),
    (8, "old.com", 0, "LOW", "LOW THREAT", 0, None), (9, "", None, None, None, None, "Empty query"), (10, "what is this", None, None, None, None, "Unrecognised input type"),
)
