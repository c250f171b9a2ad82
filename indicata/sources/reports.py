"""Raw JSON reports of providers as variants: parsed once, read by many checks.

A report is a text. It becomes a variant column, in which each check takes what it needs by path; a
path that is absent, null or of another kind gives the field's default. Reports that are no JSON object
are ``broken``, and their fields keep their defaults, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of reports: paths (the first that holds a value counts), kind, default. Names and places of the fields.
VERDICT = {
    "malicious": (("$.data.attributes.last_analysis_stats.malicious",), "int", 0),
    "suspicious": (("$.data.attributes.last_analysis_stats.suspicious",), "int", 0),
    "harmless": (("$.data.attributes.last_analysis_stats.harmless",), "int", 0),
    "undetected": (("$.data.attributes.last_analysis_stats.undetected",), "int", 0),
    "last_seen": (("$.data.attributes.last_modification_date", "$.data.attributes.last_analysis_date"), "long", None),
    "reputation": (("$.data.attributes.reputation",), "int", None),
    "tags": (("$.data.attributes.tags",), "array<string>", ()),
}
ABUSE = {
    "abuse_confidence_score": (("$.data.abuseConfidenceScore",), "int", 0),
    "total_reports": (("$.data.totalReports",), "int", 0),
    "is_tor": (("$.data.isTor",), "boolean", False),
    "country_code": (("$.data.countryCode",), "string", None),
}


def with_report(rows: DataFrame, json_col: str, into: str = "report") -> DataFrame:
    """``rows`` with the variant ``into`` and the flag ``broken``; a null text is broken."""
    parsed = F.try_parse_json(F.col(json_col))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(F.col(into)), F.lit("OBJECT")), F.lit(False))
    return rows.withColumn(into, parsed).withColumn("broken", ~is_object)


def field(report: Column, paths: tuple[str, ...], kind: str, default) -> Column:
    """The value at the first path that holds one of that kind, else the default."""
    found = [F.try_variant_get(report, p, kind) for p in paths]
    if default is None:
        return F.coalesce(*found)
    other = F.array(*map(F.lit, default)).cast(kind) if isinstance(default, tuple) else F.lit(default).cast(kind)
    return F.coalesce(*found, other)


def fields(report: Column, spec: dict) -> Column:
    """Struct of a provider's fields."""
    return F.struct(*[field(report, *s).alias(name) for name, s in spec.items()])


def pulses(report: Column) -> Column:
    """Struct of pulse_count, families and tags of a pulse report.

    Pulses stand at the top or under ``general``; the place with the higher count counts, and never fewer than are
    listed. Families are texts, or objects with a display_name, name or id.
    """
    count = lambda at: F.coalesce(F.try_variant_get(report, f"{at}.count", "int"), F.lit(0))
    top, nested = "$.pulse_info", "$.general.pulse_info"
    listed = lambda at: F.try_variant_get(report, f"{at}.pulses", "array<variant>")
    items = F.coalesce(F.when(count(top) >= count(nested), listed(top)).otherwise(listed(nested)), F.array().cast("array<variant>"))
    inner = lambda p, key: F.coalesce(F.try_variant_get(p, key, "array<variant>"), F.array().cast("array<variant>"))
    text = lambda v, path: F.when(F.try_variant_get(v, path, "string") != "", F.try_variant_get(v, path, "string"))
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    name = lambda v: F.when(is_text(v), text(v, "$")).otherwise(F.coalesce(text(v, "$.display_name"), text(v, "$.name"), text(v, "$.id")))
    families = F.array_distinct(F.array_compact(F.flatten(F.transform(items, lambda p: F.transform(inner(p, "$.malware_families"), name)))))
    tags = F.flatten(F.transform(items, lambda p: F.transform(F.filter(inner(p, "$.tags"), is_text), lambda t: F.lower(F.trim(F.try_variant_get(t, "$", "string"))))))
    return F.struct(F.greatest(count(top), count(nested), F.size(items)).alias("pulse_count"), families.alias("families"), F.array_sort(F.array_distinct(F.filter(tags, lambda t: t != ""))).alias("tags"))
