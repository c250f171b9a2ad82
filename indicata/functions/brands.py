"""Brand similarity of hostnames, as one expression per row: no explode, no shuffle.

The brand list is short and fixed, so each name's token is tried against an array
literal of the brands inside higher-order functions; tokens that share no piece with
any brand are done with first, and cheap tests on lengths and shared letters come
before the edit distance.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lists
from .hosts import without_www
from .text import homoglyph_form, homoglyph_text, let, member, one_of, similarity, text_or_empty


def _table(brands) -> Column:
    """Array of (brand, canonical form, distinct letters, rank), folded to one literal."""
    rows = [{"name": b, "form": homoglyph_text(b), "letters": sorted(set(b)), "n": len(b), "ord": k} for k, b in enumerate(brands)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<name:string,form:string,letters:array<string>,n:int,ord:int>>")


def _may_be_near(token: Column, brands) -> Column:
    """Whether a token may be one or two edits away from a brand: where it isn't, it needs no comparison.

    Of two halves of a name one edit leaves one as it is, of three parts two edits do: in
    front, at the end or between. Two edits count from nine characters on, so from names of seven.
    """
    front, end, between = set(), set(), set()
    for name in brands:
        if len(name) < 4:
            continue
        n = len(name) // 2
        cuts = [name[:n], "", name[n:]]
        if len(name) >= 7:
            n = (len(name) + 1) // 3
            cuts = [name[:n], name[n:-n], name[-n:]]
            between.add(cuts[1])
        front.add(cuts[0])
        end.add(cuts[2][::-1])
    held = F.rlike(token, F.lit(rf"\A(?:{one_of(front)})")) | F.rlike(F.reverse(token), F.lit(rf"\A(?:{one_of(end)})"))
    return (held | F.rlike(token, F.lit(one_of(between))) if between else held) if front else F.lit(False)


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def sld_tokens(domain: Column) -> Column:
    """Parts of the leftmost label of the name without www."""
    label = F.substring_index(without_www(F.lower(text_or_empty(domain))), ".", 1)
    return F.filter(F.split(label, "[-_]+"), lambda t: t != "")


def label_tokens(label: Column, infra=lists.INFRA_TOKENS) -> Column:
    return F.filter(F.split(F.lower(label), "[-_]+"), lambda t: (F.length(t) >= 4) & ~member(t, infra))


def brand_similarity(domain: Column, brands=lists.BRANDS, infra=lists.INFRA_TOKENS) -> Column:
    """Struct of brand_impersonation_flag, matched_brand, confidence and method.

    First a token that is a brand in its canonical form but not itself, or that is a
    brand within a compound name (by token, then brand); else the least edit distance.
    """
    return let(sld_tokens(domain), lambda parts: _similarity(parts, brands, infra))


def _seen(token: Column) -> Column:
    """A token with what is compared of it, computed once."""
    return F.struct(token.alias("t"), homoglyph_form(token).alias("form"), F.length(token).alias("n"), F.array_distinct(F.filter(F.split(token, ""), lambda c: c != "")).alias("letters"))


def _similarity(parts: Column, brands, infra) -> Column:
    table = _table(brands)
    compound = F.size(parts) > 1
    formed = F.transform(parts, lambda t: F.struct(t.alias("t"), homoglyph_form(t).alias("form")))
    same = F.filter(formed, lambda p: member(p["form"], [homoglyph_text(b) for b in brands]) | compound & member(p["t"], brands))
    exact = F.flatten(F.transform(same, lambda p: F.transform(
        F.filter(table, lambda b: (p["form"] == b["form"]) & (p["t"] != b["name"]) | compound & (p["t"] == b["name"])),
        lambda b: F.struct(b["name"].alias("name"), (p["t"] == b["name"]).alias("same")))))
    hit = _first(exact)

    def near(p: Column, b: Column) -> Column:
        longest = F.greatest(p["n"], b["n"])
        shared = F.size(F.array_intersect(p["letters"], b["letters"])) / F.greatest(F.size(p["letters"]), F.size(b["letters"]))
        # an edit distance is never below the difference in length
        return (F.abs(p["n"] - b["n"]) < 0.25 * longest) & (p["t"] != b["name"]) & (b["n"] >= 4) & (shared >= 0.5) & (F.levenshtein(p["t"], b["name"]) / longest < 0.25)

    # what is three edits away or more doesn't count below
    usable = F.transform(F.filter(parts, lambda t: (F.length(t) >= 5) & _may_be_near(t, brands) & ~member(t, infra)), _seen)
    fuzzy = F.flatten(F.transform(usable, lambda p, i: F.transform(
        F.filter(table, lambda b: near(p, b)),
        lambda b: F.struct(F.levenshtein(p["t"], b["name"]).alias("d"), i.alias("i"), b["ord"].alias("o"), b["name"].alias("name")))))
    # one struct, so that what is read from it below isn't computed again for each field
    return let(F.struct(hit.alias("hit"), F.array_min(fuzzy).alias("best"), F.length(_first(parts)).alias("size")), _similar_result)


def _similar_result(x: Column) -> Column:
    hit, best, size = x["hit"], x["best"], x["size"]
    length = F.length(best["name"])
    # the guard looks at the first token, whichever token matched
    one = (best["d"] == 1) & (size >= F.greatest(F.lit(3), length - 1))
    two = (best["d"] == 2) & (size >= length - 1)
    return F.struct(
        F.coalesce(hit.isNotNull() | one | two, F.lit(False)).alias("brand_impersonation_flag"),
        F.when(hit.isNotNull(), hit["name"]).when(one | two, best["name"]).alias("matched_brand"),
        F.when(hit.isNotNull() | one, "High").when(two, "Medium").alias("confidence"),
        F.when(hit["same"], "Brand token in compound domain").when(hit.isNotNull(), "Homoglyph substitution").when(one | two, "Levenshtein distance").alias("method"),
    )


def hostname_brand(host: Column, brands=lists.BRANDS, cdns=lists.BRAND_CDNS, root: Column | None = None) -> Column:
    """Struct of brand_match_hostname, matched_brand, matched_label, matched_token, context, confidence.

    Labels left of the last two are looked at, so ``paypal.co.uk`` counts as paypal on
    ``co.uk``; pass ``root`` (a registrable domain) for a split by public suffix.
    """
    h = without_www(F.lower(F.trim(text_or_empty(host))))
    parts = F.split(h, r"\.")
    root = F.substring_index(h, ".", -2) if root is None else root
    owner = F.when(F.size(parts) >= 2, F.substring_index(root, ".", 1)).otherwise("")
    labels = F.when(F.size(parts) > 2, F.slice(parts, 1, F.greatest(F.size(parts) - F.size(F.split(root, r"\.")), F.lit(0)))).otherwise(F.array().cast("array<string>"))
    pairs = F.flatten(F.transform(labels, lambda x: F.transform(label_tokens(x), lambda t: F.struct(x.alias("label"), t.alias("t"), homoglyph_form(t).alias("form"), F.length(t).alias("n")))))
    return let(F.struct(pairs.alias("pairs"), owner.alias("owner"), root.alias("root")), lambda x: _hostname(x["pairs"], x["owner"], x["root"], brands, cdns))


def _hostname(pairs: Column, owner: Column, root: Column, brands, cdns) -> Column:
    table = _table(brands)
    same = F.filter(pairs, lambda p: member(p["form"], [homoglyph_text(b) for b in brands]))
    exact = F.flatten(F.transform(same, lambda p: F.transform(
        F.filter(table, lambda b: (p["form"] == b["form"]) & ~((p["t"] == b["name"]) & (owner == b["name"]))),
        lambda b: F.struct(p["label"].alias("label"), p["t"].alias("token"), b["name"].alias("name")))))
    # what is three edits away or more doesn't count below
    fuzzy = F.flatten(F.transform(F.filter(pairs, lambda p: (p["n"] >= 5) & _may_be_near(p["t"], brands)), lambda p, i: F.transform(
        F.filter(table, lambda b: (p["n"] >= 5) & (b["n"] >= 5) & (F.abs(p["n"] - b["n"]) <= 2) & (p["form"] != b["form"]) & (p["n"] >= b["n"] - 1) & (similarity(p["t"], b["name"]) >= 0.8)),
        lambda b: F.struct(F.levenshtein(p["t"], b["name"]).alias("d"), i.alias("i"), b["ord"].alias("o"), p["label"].alias("label"), p["t"].alias("token"), b["name"].alias("name")))))
    return let(F.struct(_first(exact).alias("hit"), F.array_min(fuzzy).alias("best"), root.alias("root")), lambda x: _hostname_result(x["hit"], x["best"], x["root"], cdns))


def _hostname_result(hit: Column, best: Column, root: Column, cdns) -> Column:
    near = F.coalesce(best["d"] <= 2, F.lit(False))
    found = hit.isNotNull() | near
    pick = lambda f: F.when(hit.isNotNull(), hit[f]).when(near, best[f])
    return F.struct(
        found.alias("brand_match_hostname"), pick("name").alias("matched_brand"), pick("label").alias("matched_label"), pick("token").alias("matched_token"),
        F.when(found, F.when(member(root, cdns), "cdn_subdomain").otherwise("subdomain")).alias("context"),
        F.when(hit.isNotNull(), "High").when(near, F.when(best["d"] == 1, "High").otherwise("Medium")).alias("confidence"),
    )
