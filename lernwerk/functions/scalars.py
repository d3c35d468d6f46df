"""Scalar rules as Column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import let

GUEST_SUFFIX = "@guest.local"


def clean_key(c: Column) -> Column:
    """Small letters, without hyphens, underscores and spaces."""
    return F.translate(F.lower(c), "-_ ", "")


def extract_score(score: Column, correct: Column, total: Column) -> Column:
    """The score, else 100 times correct over total where the total is not 0."""
    return F.coalesce(score, F.try_divide(correct, total) * 100)


def interpret_effect(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size >= 0.8, "Large Effect").when(size >= 0.5, "Medium Effect").when(size >= 0.2, "Small Effect").when(size.isNotNull(), "Negligible Effect")


def interpret_gain(g: Column) -> Column:
    return F.when(g >= 0.7, "High Gain").when(g >= 0.3, "Medium Gain").when(g.isNotNull(), "Low Gain")


def is_guest(email: Column) -> Column:
    return F.lower(F.trim(email)).endswith(GUEST_SUFFIX)


def canonical_email(email: Column) -> Column:
    return F.lower(F.trim(email))


def valid_status(s: Column) -> Column:
    """The status in small letters, null where it is none of the known ones."""
    low = F.lower(F.trim(s))
    return F.when(low.isin("active", "suspended"), low)


def round_finite(c: Column, digits: int = 6) -> Column:
    """Half-even rounding; null for NaN and the infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.bround(c, digits))


def backoff_ms(failures: Column) -> Column:
    """Half a minute, doubled for every further failure, ten minutes at most."""
    return F.least(F.lit(30000) * F.pow(F.lit(2.0), F.greatest(F.lit(0), failures - 1)), F.lit(600000)).cast("long")


def tolerant_get(doc: Column, keys: list[str], inside: tuple[str, ...] = ("metrics", "complexities")) -> Column:
    """The value of a JSON object under any spelling of the keys, at the top or inside known members."""
    found = []
    for place in ("$", *(f"$.{i}" for i in inside)):
        as_map = F.from_json(F.get_json_object(doc, place), "map<string,string>")
        plain = F.transform_keys(as_map, lambda k, v: F.translate(F.lower(k), "_ ", ""))
        found += [F.try_element_at(plain, F.lit(k.lower().replace("_", "").replace(" ", ""))) for k in keys]
    return F.coalesce(*found)


def json_merge(old: Column, new: Column) -> Column:
    """Shallow merge of two JSON objects: members of ``new`` win, a JSON null too. What is no object, null too, counts as empty."""
    members = lambda c: F.coalesce(F.from_json(c, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    return F.to_json(F.map_zip_with(members(old), members(new), lambda _, a, b: F.coalesce(b, a)))


def json_set(doc: Column, path: list[str], value: Column) -> Column:
    """A JSON object with the member at ``path`` set to ``value`` (JSON text); what is no object on the way becomes one."""
    name, *rest = path
    member = lambda v: F.concat(F.lit("{" + json.dumps(name) + ":"), v, F.lit("}"))
    if not rest:
        return json_merge(doc, member(value))
    return let(doc, lambda d: json_merge(d, member(json_set(F.get_json_object(d, f"$['{name}']"), rest, value))))
