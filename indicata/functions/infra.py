"""Hosting infrastructure from a host, its CNAMEs, its certificate and its network's owner.

First match wins in every table: tables are ordered, and so are the rules drawn from
them. All are CASE expressions over short fixed tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, contains_any, is_ip_literal, text_or_empty

#: Fixed values, in priority order: host suffix and provider. All deploy rapidly.
DIRECT = (
    ("vercel.app", "Vercel", "Direct Vercel platform domain (*.vercel.app)"),
    ("now.sh", "Vercel", "Direct Vercel platform domain (*.now.sh)"),
    ("netlify.app", "Netlify", "Direct Netlify platform domain (*.netlify.app)"),
    ("pages.dev", "Cloudflare Pages", "Direct Cloudflare Pages domain (*.pages.dev)"),
    ("onrender.com", "Render", "Direct Render platform domain (*.onrender.com)"),
    ("railway.app", "Railway", "Direct Railway platform domain (*.railway.app)"),
    ("up.railway.app", "Railway", "Direct Railway platform domain (*.up.railway.app)"),
    ("github.io", "GitHub Pages", "Direct GitHub Pages domain (*.github.io)"),
    ("web.app", "Firebase Hosting", "Direct Firebase Hosting domain (*.web.app)"),
    ("firebaseapp.com", "Firebase Hosting", "Direct Firebase Hosting domain (*.firebaseapp.com)"),
    ("sites.google.com", "Google Sites", "Direct Google Sites domain (sites.google.com/*)"),
    ("storage.googleapis.com", "Google Cloud Storage", "Direct Google Cloud Storage public hosting"),
    ("edgeone.app", "Tencent EdgeOne", "Direct EdgeOne platform domain (*.edgeone.app)"),
    ("fastly.net", "Fastly Edge Infrastructure", "Direct Fastly infrastructure endpoint"),
    ("global.ssl.fastly.net", "Fastly Edge Infrastructure", "Direct Fastly infrastructure endpoint"),
    ("fastlylb.net", "Fastly Edge Infrastructure", "Direct Fastly infrastructure endpoint"),
)
RAPID, CDN, CLOUD = "Rapid Deploy CDN", "Enterprise CDN", "Enterprise Cloud"
#: Fixed values, in priority order: platform, category, CNAME endings, words of the network's owner, words of the issuer, whether only a CNAME shows rapid deployment.
PLATFORMS = (
    ("Vercel", RAPID, ("vercel.app", "vercel.com", "now.sh"), ("vercel",), (), False),
    ("Netlify", RAPID, ("netlify.app", "netlify.com"), ("netlify",), (), False),
    ("Firebase Hosting", RAPID, ("web.app", "firebaseapp.com"), (), (), False),
    ("Render", RAPID, ("onrender.com",), ("render",), (), False),
    ("Railway", RAPID, ("railway.app", "up.railway.app"), ("railway",), (), True),
    ("GitHub Pages", RAPID, ("github.io",), ("github",), (), True),
    ("Cloudflare Pages", RAPID, ("pages.dev",), (), (), True),
    ("Fastly", CDN, ("fastly.net", "fastlylb.net"), ("fastly",), (), True),
    ("Cloudflare", CDN, (), ("cloudflare",), ("cloudflare",), True),
    ("Akamai", CDN, ("akamaiedge.net", "akamaitechnologies.com", "akamai.net"), ("akamai",), (), True),
    ("AWS CloudFront", CLOUD, ("cloudfront.net",), ("amazon", "aws"), ("amazon",), True),
    ("AWS", CLOUD, ("amazonaws.com", "awscloud.com"), ("amazon", "aws"), (), True),
    ("Azure", CLOUD, ("azurewebsites.net", "azureedge.net", "windows.net"), ("microsoft", "azure"), (), True),
    ("Google Cloud", CLOUD, ("googleapis.com", "googleusercontent.com"), ("google",), (), True),
)
#: Words of owners that no platform above has claimed.
OWNERS = (
    ("azure", "Azure"), ("microsoft", "Azure"), ("amazon", "AWS"), ("aws", "AWS"), ("digitalocean", "DigitalOcean"),
    ("linode", "Linode"), ("vultr", "Vultr"), ("hetzner", "Hetzner"), ("ovh", "OVH"), ("google", "Google Cloud"),
)


def _found(provider, category, rapid, method) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(provider).alias("provider"), lit(category).alias("category"), lit(rapid).alias("rapid_deploy"), lit(method).alias("method"))


def by_host(host: Column) -> Column:
    h = F.lower(F.trim(host))
    return F.coalesce(*[F.when((h == s) | F.endswith(h, F.lit("." + s)), _found(p, RAPID, True, m)) for s, p, m in DIRECT])


def by_cname(cnames: Column) -> Column:
    """Endings without a dot before them count, and a trailing dot doesn't hide them."""
    names = F.transform(F.coalesce(cnames, F.array().cast("array<string>")), lambda c: F.rtrim(F.lower(c), F.lit(".")))
    some = lambda ends: F.exists(names, lambda c: any_of([F.endswith(c, F.lit(x)) for x in ends]))
    rules = [(some(ends), p, k) for p, k, ends, *_ in PLATFORMS if ends]
    return F.coalesce(*[F.when(ok, _found(p, k, k == RAPID, "CNAME record")) for ok, p, k in rules])


def by_owner(owner: Column) -> Column:
    s = F.lower(text_or_empty(owner))
    return F.coalesce(*[F.when(contains_any(s, w), _found(p, k, k == RAPID and not need, "ASN/Organization")) for p, k, _, w, _, need in PLATFORMS if w])


def by_issuer(issuer: Column, issuer_cn: Column) -> Column:
    s = F.lower(F.concat(text_or_empty(issuer), F.lit(" "), text_or_empty(issuer_cn)))
    return F.coalesce(*[F.when(contains_any(s, w), _found(p, k, k == RAPID and not need, "TLS certificate issuer")) for p, k, _, _, w, need in PLATFORMS if w])


def unmatched(owner: Column) -> Column:
    s = F.trim(text_or_empty(owner))
    method = "ASN/Organization (unclassified)"
    return F.coalesce(
        *[F.when(F.contains(F.lower(s), F.lit(w)), _found(p, "Cloud Hosting Provider", False, method)) for w, p in OWNERS],
        F.when(s != "", _found(s, "Unclassified Hosting Provider", False, method)),
        _found("Unresolved", "Unresolved Infrastructure", False, method),
    )


def infrastructure(host: Column, cnames: Column, owner: Column, issuer: Column, issuer_cn: Column, tls_error: Column) -> Column:
    """Struct of provider, category, rapid_deploy and method.

    Addresses go by their owner alone. For names the certificate comes before the
    owner, whom one asks only when nothing else has told.
    """
    ip = is_ip_literal(text_or_empty(host))
    cert = F.when(tls_error.isNull() | (tls_error == ""), by_issuer(issuer, issuer_cn))
    return F.coalesce(F.when(~ip, by_host(host)), F.when(~ip, by_cname(cnames)), F.when(~ip, cert), by_owner(owner), unmatched(owner))
