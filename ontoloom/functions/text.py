"""Text builders, short ids and the vector functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in DOUBLE; an error for unequal dimensions, null for a zero vector."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("dimension mismatch")).cast("double"))


def normalise_threshold(value: Column) -> Column:
    """A similarity threshold given as a share or in percent: not above 0 is 0, above 1 is divided by 100."""
    return F.when(value <= 0, 0.0).when(value <= 1, value).otherwise(value / 100)


def entity_text(properties: Column) -> Column:
    """'key: value' of the entries of a map, by key, joined by '. '; null values are skipped."""
    entries = F.array_sort(F.map_entries(F.map_filter(properties, lambda k, v: v.isNotNull())))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ". ")


def event_text(properties: Column) -> Column:
    """Text of a VARIANT: a string as it is; of an object 'key: value' of its strings, numbers and booleans, by key, joined by '. '; else empty."""
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)
    entries = F.array_sort(F.map_keys(F.try_variant_get(properties, "$", "map<string,variant>")))
    fields = F.try_variant_get(properties, "$", "map<string,variant>")
    parts = F.transform(entries, lambda k: F.when(kind(fields[k]).isin("STRING", "BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN"), F.concat(k, F.lit(": "), fields[k].cast("string"))))
    whole = F.array_join(F.filter(parts, lambda x: x.isNotNull()), ". ")
    return F.when(kind(properties) == "STRING", properties.cast("string")).when(kind(properties) == "OBJECT", whole).otherwise("")


def searchable_text(head: list[Column], metadata: Column) -> Column:
    """Parts and the metadata's strings, by key, joined by ' | '; nulls and empty parts are skipped."""
    values = F.transform(F.array_sort(F.map_entries(F.coalesce(metadata, F.create_map().cast("map<string,string>")))), lambda e: e["value"])
    parts = F.concat(F.array(*head), values)
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " | ")


def searchable_variant(head: list[Column], metadata: Column) -> Column:
    """searchable_text for a VARIANT: of an object's values, by key, the strings and the strings in arrays, in order; all else is skipped."""
    fields = F.try_variant_get(metadata, "$", "map<string,variant>")
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)
    strings = lambda a: F.transform(F.filter(a, lambda v: kind(v) == "STRING"), lambda v: v.cast("string"))
    none = F.array().cast("array<string>")
    found = F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.when(kind(fields[k]) == "STRING", F.array(fields[k].cast("string"))).when(kind(fields[k]) == "ARRAY", strings(F.try_variant_get(fields[k], "$", "array<variant>"))).otherwise(none))
    parts = F.concat(F.array(*head), F.coalesce(F.flatten(found), none))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " | ")


METADATA_KEYS = ("role", "goal", "backstory", "description", "expected_output", "agent")  # fixed values: the keys that are read, in this order


def metadata_text(metadata: Column, keys: tuple[str, ...] = METADATA_KEYS) -> Column:
    """The trimmed values of the given keys in order, joined by '. '; if there are none, all other values in the map's order. Nulls and blanks are skipped; a null map has no text."""
    known = F.array(*[F.trim(F.try_element_at(metadata, F.lit(k))) for k in keys])
    full = lambda a: F.array_join(F.filter(a, lambda x: x.isNotNull() & (x != "")), ". ")
    rest = F.transform(F.map_values(metadata), lambda x: F.trim(x))
    return F.coalesce(F.nullif(full(known), F.lit("")), full(rest), F.lit(""))


def log_text(level: Column, message: Column) -> Column:
    return F.concat_ws(" | ", F.upper(level), message)


def thought_text(step: Column, content: Column) -> Column:
    return F.format_string("Step %d: %s", step, content)


def short_id(seed: Column, size: int = 10) -> Column:
    """A deterministic id: base64 of the SHA-1 with '+' as A, '/' as B and without '=', cut to size characters."""
    return F.substring(F.translate(F.base64(F.unhex(F.sha1(seed))), "+/=", "AB"), 1, size)


def is_error_level(level: Column) -> Column:
    return F.upper(level).isin("ERROR", "CRITICAL")


def mentions_error(text: Column) -> Column:
    """Contains 'error' or 'Error', in just these two spellings."""
    return text.contains("error") | text.contains("Error")


def node_label(name: Column, title: Column, node_id: Column) -> Column:
    """The name, else the title, else the first eight characters of the id; empty strings count as missing."""
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(title, F.lit("")), F.substring(node_id, 1, 8))
