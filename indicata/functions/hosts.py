"""Hostnames: normal form, public-suffix split, entropy, top-level-domain risk and hosting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lists
from .text import let, member, round2, shannon_entropy, strings, text_or_empty, tokens


def normal_host(raw: Column) -> Column:
    """Lower-case host without scheme, path, brackets or port."""
    s = F.regexp_replace(F.lower(F.trim(text_or_empty(raw))), r"^[a-z][a-z0-9+\-.]*://", "")
    s = F.substring_index(s, "/", 1)
    colons = F.length(s) - F.length(F.replace(s, F.lit(":"), F.lit("")))
    return (
        F.when(F.startswith(s, F.lit("[")), F.substring_index(F.regexp_replace(s, r"^\[+", ""), "]", 1))
        .when(colons == 1, F.substring_index(s, ":", 1))
        .otherwise(s)
    )


def without_www(host: Column) -> Column:
    return F.when(F.startswith(host, F.lit("www.")), F.substring(host, 5, 1 << 30)).otherwise(host)


def looks_like_ip(host: Column) -> Column:
    """By shape alone: dotted digits, or only hex digits and colons (so ``cafe`` does)."""
    return host.rlike(r"^(\d{1,3}\.){3}\d{1,3}$") | host.rlike(r"^\[?[0-9a-f:]+\]?$")


def host_context(raw: Column, two_label_suffixes=lists.TWO_LABEL_SUFFIXES) -> Column:
    """Struct of hostname, registrable_domain, subdomain_labels, domain and suffix.

    The suffix is the longest of the two-label list, else the last label. The list
    stands for a full public-suffix list and can be replaced.
    """
    split = lambda host: F.struct(host.alias("h"), F.split(host, r"\.").alias("p"), looks_like_ip(host).alias("ip"), F.substring_index(host, ".", -2).alias("two"))
    known = lambda x: F.struct(*[x[k].alias(k) for k in ("h", "p", "ip", "two")], ((F.size(x["p"]) >= 3) & member(x["two"], two_label_suffixes)).alias("wide"))
    return let(without_www(normal_host(raw)), lambda host: let(split(host), lambda s: let(known(s), lambda x: _context(x["h"], x["p"], x["ip"], x["two"], x["wide"]))))


def _context(host: Column, parts: Column, ip: Column, two: Column, wide: Column) -> Column:
    n = F.size(parts)
    bare = ip | (n < 2)
    suffix = F.when(bare, "").when(wide, two).otherwise(F.substring_index(host, ".", -1))
    domain = F.when(bare, host).when(wide, F.get(parts, n - 3)).otherwise(F.get(parts, n - 2))
    registrable = F.when((domain != "") & (suffix != ""), F.concat(domain, F.lit("."), suffix)).when(domain != "", domain).otherwise(host)
    labels = F.when(bare, strings([])).otherwise(F.filter(F.slice(parts, 1, F.greatest(n - F.when(wide, 3).otherwise(2), F.lit(0))), lambda x: x != ""))
    return F.struct(host.alias("hostname"), registrable.alias("registrable_domain"), labels.alias("subdomain_labels"), domain.alias("domain"), suffix.alias("suffix"))


def tld_risk(domain: Column, two_label_suffixes=lists.TLD_TWO_LABEL_SUFFIXES, safe=lists.SAFE_TLDS, medium=lists.MEDIUM_TLDS) -> Column:
    """Struct of tld, risk_level and score_added: the medium list first, then the safe one; all else is high."""
    host = F.lower(F.trim(text_or_empty(domain)))
    n = F.size(F.split(host, r"\."))
    two = F.substring_index(host, ".", -2)
    tld = F.when(host == "", "").when((n >= 3) & member(two, two_label_suffixes), F.concat(F.lit("."), two)).when(n > 1, F.concat(F.lit("."), F.substring_index(host, ".", -1))).otherwise("")
    level = lambda t: F.when(member(t, medium), "Medium").when(member(t, safe), "Low").otherwise("High")
    both = let(tld, lambda t: F.struct(t.alias("t"), level(t).alias("l")))
    return let(both, lambda x: F.struct(x["t"].alias("tld"), x["l"].alias("risk_level"), F.when(x["l"] == "Medium", 5).when(x["l"] == "Low", 0).otherwise(15).alias("score_added")))


def domain_entropy(context: Column) -> Column:
    """Struct of entropy_score, entropy_level and label, from the registrable label without hyphens."""
    label = F.replace(context["domain"], F.lit("-"), F.lit(""))
    score = round2(shannon_entropy(label))
    return let(score, lambda s: F.struct(s.alias("entropy_score"), F.when(s < 3.1, "Low").when(s < 3.8, "Moderate").otherwise("High").alias("entropy_level"), label.alias("label")))


def subdomain_entropy(context: Column, moderate: bool = True) -> Column:
    """Struct of subdomain_entropy_score, subdomain_entropy_level, subdomain_label and scored.

    The outermost label without hyphens counts, from seven characters on. There are
    three levels, or two where ``moderate`` is false (the older signal).
    """
    label = F.replace(F.get(context["subdomain_labels"], F.lit(0)), F.lit("-"), F.lit(""))
    score = F.when(F.length(label) > 6, round2(shannon_entropy(label)))

    def told(score: Column) -> Column:
        level = F.when(score >= 3.6, "High")
        if moderate:
            level = level.when(score >= 2.8, "Moderate")
        level = level.when(score.isNotNull(), "Low")
        return F.struct(score.alias("subdomain_entropy_score"), level.alias("subdomain_entropy_level"), label.alias("subdomain_label"), F.coalesce(level != "Low", F.lit(False)).alias("scored"))

    return let(score, told)


def naive_registrable(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(F.lower(F.trim(host)), ".", -2)


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` gives a.b.c, b.c and c: turns a test for a suffix into equality."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def cdn_hosting(context: Column, cdns=lists.CDNS) -> Column:
    reg = context["registrable_domain"]
    return F.struct(member(reg, cdns).alias("cdn_hosted"), F.when(member(reg, cdns), reg).alias("cdn_provider"))


def abused_hosting(context: Column, abused=lists.ABUSED_HOSTING) -> Column:
    """Struct of abused_hosting and platform: the registrable domain, else the first deep entry (sorted) that the host ends with."""
    reg, host = context["registrable_domain"], F.rtrim(context["hostname"], F.lit("."))
    deep = sorted(a for a in abused if a.count(".") >= 2)
    under = F.coalesce(*[F.when((host == d) | F.endswith(host, F.lit("." + d)), d) for d in deep])
    platform = F.when(member(reg, abused), reg).otherwise(under)
    return F.struct(platform.isNotNull().alias("abused_hosting"), platform.alias("platform"))


def lure_keywords(context: Column, lures=lists.LURES, safe=lists.SAFE_TLDS, medium=lists.MEDIUM_TLDS) -> Column:
    """Struct of lure_detected, matched_lures and lure_count; words that are top-level domains never count."""
    words = [t.lstrip(".") for t in (*safe, *medium)]
    tld_words = sorted({w for w in words if "." not in w})
    usable = [w for w in lures if w not in tld_words]
    found = F.filter(tokens(context["hostname"]), lambda t: member(t, usable) & (t != context["suffix"]))
    return F.struct((F.size(found) > 0).alias("lure_detected"), found.alias("matched_lures"), F.size(found).alias("lure_count"))


def brand_tokens(context: Column, brands=lists.BRANDS, cdns=lists.CDNS, abused=lists.ABUSED_HOSTING) -> Column:
    """Struct of brand_detected, matched_brands, brand_count, matched_brand, context and source_label.

    All tokens that are brands count, but for a content network's own name and the
    owner of a deep hosting entry (google in sites.google.com).
    """
    host, reg, labels = context["hostname"], context["registrable_domain"], context["subdomain_labels"]
    is_cdn = member(reg, cdns)
    own = F.when(is_cdn, F.substring_index(reg, ".", 1))
    deep = [(a, a.split(".")[-2]) for a in abused if a.count(".") >= 2]
    owners = F.filter(F.array(*[F.when((host == a) | F.endswith(host, F.lit("." + a)), o) for a, o in deep]), lambda x: x.isNotNull())
    chosen = F.filter(tokens(host), lambda t: member(t, brands) & ~F.coalesce(t == own, F.lit(False)) & ~F.array_contains(owners, t))
    return let(chosen, lambda found: _brand_place(found, reg, labels, is_cdn))


def _brand_place(found: Column, reg: Column, labels: Column, is_cdn: Column) -> Column:
    first = F.get(found, F.lit(0))
    label = F.get(F.filter(labels, lambda x: F.array_contains(tokens(x), first)), F.lit(0))
    root = F.substring_index(reg, ".", 1)
    in_root = F.array_contains(tokens(root), first)
    place = F.when(first.isNull(), F.lit(None)).when(label.isNotNull(), F.when(is_cdn, "cdn_subdomain").otherwise("subdomain")).when(in_root, "root").otherwise("subdomain")
    return F.struct(
        (F.size(found) > 0).alias("brand_detected"), found.alias("matched_brands"), F.size(found).alias("brand_count"), first.alias("matched_brand"),
        place.alias("context"), F.when(first.isNotNull(), F.coalesce(label, F.when(in_root, root))).alias("source_label"),
    )


def subnet24(ip: Column) -> Column:
    """The first three octets of a dotted address, else empty."""
    dots = F.length(ip) - F.length(F.replace(ip, F.lit("."), F.lit("")))
    return F.when(dots == 3, F.substring_index(ip, ".", 3)).otherwise("")
