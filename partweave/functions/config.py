"""Configuration text as map columns.

``key = value # comment`` lines (or ``key=value;...``); the last write of a key
wins. Namespaces are dotted prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """map<string,string> of a configuration text."""
    lines = F.filter(
        F.transform(F.split(text, "[;\n]"), lambda s: F.trim(F.regexp_replace(s, "#.*", ""))), lambda s: F.contains(s, F.lit("="))
    )
    pairs = F.transform(
        lines, lambda s: F.struct(F.trim(F.substring_index(s, "=", 1)).alias("k"), F.trim(F.regexp_replace(s, "^[^=]*=", "")).alias("v"), )
    )
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    # The last pair of each key.
    last = F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("v")))
    return F.map_from_entries(last)


def namespace(conf: Column, name: str) -> Column:
    """The keys under ``name.``, without it."""
    prefix = name + "."
    own = F.map_filter(conf, lambda k, _: F.startswith(k, F.lit(prefix)))
    return F.transform_keys(own, lambda k, _: F.substring(k, len(prefix) + 1, 1 << 30))


def root(conf: Column) -> Column:
    return F.map_filter(conf, lambda k, _: ~F.contains(k, F.lit(".")))


def overlaid(base: Column, top: Column) -> Column:
    """``base`` with the keys of ``top`` put over it."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(top, k))
    return F.map_concat(kept, top)


def with_namespaces(conf: Column, names: list[str]) -> Column:
    out = root(conf)
    for name in names:
        out = overlaid(out, namespace(conf, name))
    return out


def resolved(conf: Column, name: str) -> Column:
    """``name.*`` with the keys of the namespace that ``name.from_namespace``
    names added under it; own keys are not overridden."""
    own = namespace(conf, name)
    other = F.element_at(own, "from_namespace")
    lent = F.map_filter(conf, lambda k, _: F.startswith(k, F.concat(other, F.lit("."))))
    lent = F.transform_keys(lent, lambda k, _: F.substring(k, F.length(other) + 2, F.lit(1 << 30)))
    own = F.map_filter(own, lambda k, _: k != "from_namespace")
    return F.when(other.isNull(), own).otherwise(overlaid(lent, own))


def get(conf: Column, key: str, kind: str, default=None) -> Column:
    """A typed value; the default where the key is missing or does not parse."""
    found = F.element_at(conf, key).try_cast(kind)
    return found if default is None else F.coalesce(found, F.lit(default).cast(kind))


def get_vector(conf: Column, key: str, kind: str = "double") -> Column:
    return F.transform(F.split(F.element_at(conf, key), ","), lambda s: F.trim(s).try_cast(kind))


def required(conf: Column, key: str, kind: str) -> Column:
    found = F.element_at(conf, key)
    return F.when(found.isNull(), F.raise_error(F.lit(f"missing key {key}"))).otherwise(found).cast(kind)
