"""Canonical JSON, digests, money, time, and other column helpers."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

KEEP_NULLS = {"ignoreNullFields": "false"}


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """Compact JSON text of the fields in name order, NULLs kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), KEEP_NULLS)


def digest(fields: Mapping[str, Column]) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(fields), 256)


def digest_matches(recorded: Column, fields: Mapping[str, Column]) -> Column:
    """True when a recorded self-digest equals the digest of the other fields."""
    return recorded.eqNullSafe(digest(fields))


def packed(name: Column) -> Column:
    """A text as bytes that stand for it and no other; texts of lower-case hexadecimal pairs, like digests, take half their length."""
    return F.when(name.rlike(r"\A(?:[0-9a-f]{2})+\z"), F.concat(F.lit(b"\x01"), F.unhex(name))).otherwise(F.concat(F.lit(b"\x00"), name.cast("binary")))


def unpacked(key: Column) -> Column:
    """The text that ``packed`` made the bytes of."""
    rest = F.substring(key, 2, 1 << 30)
    return F.when(F.substring(key, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def map_key(values: Column) -> Column:
    """A map as a string usable as a join or grouping key (pairs in key order)."""
    pairs = F.array_sort(F.map_entries(values))
    return F.coalesce(F.to_json(F.map_from_entries(pairs)), F.lit("{}"))


def normal_text(text: Column) -> Column:
    """Inner white space of any kind to one blank, outer removed; empty becomes NULL."""
    squeezed = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(squeezed != "", squeezed)


def qualifier_key(qualifiers: Column) -> Column:
    """Normalised qualifiers as a canonical string."""
    pairs = F.transform(
        F.map_entries(qualifiers),
        lambda e: F.struct(normal_text(e["key"]).alias("key"), normal_text(e["value"]).alias("value")),
    )
    text = F.transform(F.array_sort(pairs), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.concat_ws(";", text)


def cents(amount: Column) -> Column:
    """Decimal money held as double into whole minor units."""
    return F.round(amount * 100).cast("long")


def half_even(value: Column, places: int = 0) -> Column:
    return F.bround(value, places)


def ratio(part: Column, whole: Column, places: int) -> Column:
    """part / whole rounded half to even; NULL when whole is 0 or NULL."""
    return F.bround(F.try_divide(part.cast("double"), whole.cast("double")), places)


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3.6e9)


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text with a mandatory zone as a timestamp; NULL when either is missing."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.try_to_timestamp(text))


def iso_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def shown(value: Column) -> Column:
    """Text of a value, with a question mark for what is not known."""
    return F.coalesce(value.cast("string"), F.lit("?"))


def hash_number(text: Column, digits: int = 8) -> Column:
    """A non-negative number from the first hex digits (at most 15) of SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("long")


def url_host(url: Column) -> Column:
    """Host of a URL without port or user part, lower case; NULL when there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", F.lower(host))


# Forms of episode ids, asset paths and template names.
EPISODE_ID = r"^episode_(.+)_v1$"
ASSET_PATH = r"([^/]+)\.v1\.json$"


def id_to_path(episode_id: Column) -> Column:
    """Asset path of an id of the form episode_<stem>_v1; NULL for any other."""
    stem = F.regexp_extract(episode_id, EPISODE_ID, 1)
    return F.when(stem != "", F.concat(F.lit("episodes_v2/"), stem, F.lit(".v1.json")))


def path_to_id(path: Column) -> Column:
    stem = F.regexp_extract(path, ASSET_PATH, 1)
    return F.when(stem != "", F.concat(F.lit("episode_"), stem, F.lit("_v1")))


def template_to_family(template: Column) -> Column:
    """Family name of a template: without the eval_ prefix and the _r2 suffix."""
    return F.regexp_replace(F.regexp_replace(template, "^eval_", ""), "_r2$", "")
