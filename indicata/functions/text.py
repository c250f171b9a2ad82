"""Scalar expressions on strings, and small array helpers. All are built-in functions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_
from os.path import commonprefix

from pyspark.sql import Column
from pyspark.sql import functions as F


def strings(values) -> Column:
    """An array of constant strings, which is folded to one literal however long it is."""
    values = list(values)
    return F.split(F.lit("\x01".join(values)), "\x01") if values else F.array().cast("array<string>")


def member(value: Column, values) -> Column:
    """Whether a string is one of the constants; one small expression, unlike ``isin`` of a long list, and one pattern, unlike a comparison with each."""
    return F.rlike(value, F.lit(rf"\A(?:{one_of(values)})\z" if values else "(?!)"))


def present(values: Column) -> Column:
    """An array without its nulls."""
    return F.filter(values, lambda x: x.isNotNull())


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def any_of(conditions) -> Column:
    return reduce(or_, conditions)


def holds_any(words) -> str:
    """A pattern that finds one of the words. Those with a dot are tried only where their last dot and its ending stand, looking back from there, so a text isn't tried against each word at each place."""
    endings: dict[str, list[str]] = {}
    for word in words:
        endings.setdefault(word[word.rfind(".") :] if "." in word else word, []).append(word)
    return "|".join(re.escape(end) + ("" if end in held else "(?:" + "|".join(f"(?<={re.escape(w)})" for w in held) + ")") for end, held in endings.items())


def one_of(words) -> str:
    """A pattern of the words in which those with the same beginning stand together, so a text is tried against few of them."""
    by_sign: dict[str, set[str]] = {}
    for word in words:
        by_sign.setdefault(word[:1], set()).add(word)
    parts = []
    for held in (sorted(by_sign[s]) for s in sorted(by_sign) if s):
        start = commonprefix(held)
        parts.append(re.escape(start) + ("" if len(held) == 1 else f"(?:{one_of([w[len(start) :] for w in held])})"))
    return "|".join(parts + [""] * ("" in by_sign))


def contains_any(value: Column, words) -> Column:
    """Whether a string holds one of the words: one pattern, so one expression."""
    return F.rlike(value, F.lit(holds_any(words)))


def ends_with_any(value: Column, suffixes) -> Column:
    return F.rlike(value, F.lit("(?:" + "|".join(map(re.escape, suffixes)) + r")\z"))


def matches(value: Column, pattern: str, held: str) -> Column:
    """All matches of a pattern in a text; ``held`` is what each of them holds: one cheap search, after which most texts are done with."""
    return F.when(value.rlike(held), F.regexp_extract_all(value, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: expressions that use it often stay small."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def pinned(df):
    """The same rows, whose columns later expressions don't repeat: nothing is inlined below explode."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_row")).select("_row.*")


def sanitize(raw: Column) -> Column:
    """Trimmed, without control characters, at most 512 characters; null is empty."""
    trimmed = F.regexp_replace(text_or_empty(raw), r"^[\s\x1c-\x1f\x85 ]+|[\s\x1c-\x1f\x85 ]+$", "")
    return F.substring(F.regexp_replace(trimmed, r"[\x00-\x1f\x7f]", ""), 1, 512)


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_H = "[0-9a-fA-F]{1,4}"


def _ipv6() -> str:
    """All spellings of an IPv6 address: eight groups, or fewer around one ::, the last two maybe dotted."""
    forms = [rf"(?:{_H}:){{7}}{_H}", rf"(?:{_H}:){{6}}{IPV4}"]
    for left in range(8):
        head = rf"(?:{_H}(?::{_H}){{{left - 1}}})?" if left > 1 else (rf"(?:{_H})?" if left == 1 else "")
        if left:
            head = head[: -1] if head.endswith("?") else head
        right = 7 - left
        tails = [rf"(?:{_H}(?::{_H}){{0,{right - 1}}})?" if right else ""]
        if right >= 2:
            tails.append(rf"(?:{_H}:){{0,{right - 2}}}{IPV4}")
        forms += [rf"{head}::{t}" for t in tails]
    return "(?:" + "|".join(forms) + ")"


IPV6 = _ipv6()
_SCOPE = r"(?:%[^%/]+)?"
_PREFIX4, _PREFIX6 = r"(?:3[0-2]|[12]?[0-9])", r"(?:12[0-8]|1[01][0-9]|[1-9]?[0-9])"
#: Netmasks and hostmasks that a dotted prefix may be.
_MASK_OCTET = "(?:0|128|192|224|240|248|252|254|255)"
_NETMASK = r"(?:" + "|".join(r"255\." * k + _MASK_OCTET + r"\.0" * (3 - k) for k in range(4)) + ")"
_HOSTMASK = r"(?:" + "|".join(r"0\." * k + "(?:0|1|3|7|15|31|63|127|255)" + r"\.255" * (3 - k) for k in range(4)) + ")"
DOMAIN = r"(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}"


def is_ip_literal(value: Column) -> Column:
    return value.rlike(f"^(?:{IPV4}|{IPV6}{_SCOPE})$")


def is_cidr(value: Column) -> Column:
    return value.rlike(f"^(?:{IPV4}/(?:0*{_PREFIX4}|{_NETMASK}|{_HOSTMASK})|{IPV6}{_SCOPE}/0*{_PREFIX6})$")


def input_type(value: Column) -> Column:
    """ip, domain, url, hash or unknown."""
    v = F.trim(text_or_empty(value))
    return (
        F.when(v.rlike("^(?i)(?:https?|ftp)://"), "url")
        .when(is_ip_literal(v) | is_cidr(v), "ip")
        .when(v.rlike("^(?:[a-fA-F0-9]{32}|[a-fA-F0-9]{40}|[a-fA-F0-9]{64})$"), "hash")
        .when(v.rlike(f"^{DOMAIN}$"), "domain")
        .otherwise("unknown")
    )


def client_input_type(value: Column) -> Column:
    """The looser rule of an input form: addresses first, digits unchecked, no ftp."""
    v = F.trim(text_or_empty(value))
    return (
        F.when(v.rlike(r"^(\d{1,3}\.){3}\d{1,3}$") | v.rlike("^[0-9a-fA-F:]+$") & F.contains(v, F.lit(":")), "ip")
        .when(v.rlike("^(?i)https?://"), "url")
        .when(v.rlike("^(?:[a-fA-F0-9]{32}|[a-fA-F0-9]{40}|[a-fA-F0-9]{64})$"), "hash")
        .when(v.rlike(f"^{DOMAIN}$"), "domain")
        .otherwise("unknown")
    )


def shannon_entropy(value: Column) -> Column:
    """Bits per character; the empty string has 0."""
    n = F.length(value)
    letters = F.array_distinct(F.filter(F.split(value, ""), lambda c: c != ""))
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    total = F.aggregate(F.transform(letters, share), F.lit(0.0), lambda a, p: a + p * F.log2(p))
    return F.when(n > 0, -total).otherwise(F.lit(0.0))


def round2(value: Column) -> Column:
    """Two decimals, ties to even, of the double itself: 1.015 lies below its decimal form and is 1.01, where ``bround`` takes the form for a tie."""
    return F.rint(value * 100) / 100


def tokens(host: Column) -> Column:
    """Distinct lower-case parts between dots, hyphens and underscores, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(text_or_empty(host)), r"[.\-_]+"), lambda t: t != ""))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty strings are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def homoglyph_form(value: Column) -> Column:
    """A canonical form in which letters and signs that look alike are the same.

    Fixed values: single signs swap sides, then m is rn, w is vv and @ is a.
    """
    s = F.translate(F.lower(value), "oliseazbg", "011534286")
    return F.replace(F.replace(F.replace(s, F.lit("m"), F.lit("rn")), F.lit("w"), F.lit("vv")), F.lit("@"), F.lit("a"))


def homoglyph_text(value: str) -> str:
    """``homoglyph_form`` of a constant."""
    return value.lower().translate(str.maketrans("oliseazbg", "011534286")).replace("m", "rn").replace("w", "vv").replace("@", "a")


def ordered_dedup(values: Column) -> Column:
    """Trimmed, not empty, first of equals."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def masked_key(key: Column) -> Column:
    """First four and last four characters with bullets between; keys of eight or fewer are all bullets."""
    n = F.length(key)
    return F.when(key.isNull() | (n == 0), "").when(n <= 8, F.repeat(F.lit("•"), n)).otherwise(F.concat(F.substring(key, 1, 4), F.repeat(F.lit("•"), n - 8), F.substring(key, -4, 4)))


def escape_html(value: Column) -> Column:
    out = text_or_empty(value)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def percent_decoded(value: Column) -> Column:
    """Percent escapes as UTF-8 text; a broken escape stays, plus signs stay."""
    safe = F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(F.replace(safe, F.lit("+"), F.lit("%2B"))), value)
