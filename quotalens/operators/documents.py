"""JSON documents compared and changed."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _adds(old, new) -> bool:
    if isinstance(old, dict) and isinstance(new, dict):
        return all(k in new and _adds(v, new[k]) for k, v in old.items())
    if isinstance(old, list) and isinstance(new, list):
        return len(old) == len(new) and all(map(_adds, old, new))
    return old is None or old == new and isinstance(old, bool) == isinstance(new, bool)


def adds_to(old: str | None, new: str | None) -> bool | None:
    """F8: whether the new JSON keeps all that the old one says and at most fills nulls or adds keys; None if either is no JSON."""
    try:
        return _adds(json.loads(old), json.loads(new))
    except (TypeError, ValueError):
        return None


def _enriched(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([adds_to(a, b) for a, b in zip(old, new)], dtype="boolean")


def is_enrichment(old: Column, new: Column) -> Column:
    """F8 of two columns. Depth is unbounded, so no built-in expresses it."""
    return F.pandas_udf(_enriched, "boolean")(old, new)


#: Levels of objects that ``patched`` merges one by one; below, the patch's member replaces the document's.
DEPTH = 6
_MEMBERS = "map<string,variant>"


def _members(v: Column) -> Column:
    """The members of a variant that is an object; null for any other."""
    return F.try_variant_get(v, "$", _MEMBERS)


def _bound(made, *columns: Column) -> Column:
    """``made`` of columns that are computed once, whatever it does with them."""
    names = [f"v{k}" for k in range(len(columns))]
    return F.transform(F.array(F.struct(*[c.alias(n) for c, n in zip(columns, names)])), lambda x: made(*[x[n] for n in names]))[0]


def _object(keys: Column, value) -> Column:
    return F.to_variant_object(F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), value(k).alias("value")))))


_NONE = lambda: F.create_map().cast(_MEMBERS)


def _merged(old: Column, new: Column, depth: int) -> Column:
    """RFC 7396 on variants: a member of the patch that is null removes, an object merges, anything else replaces."""

    def objects(was: Column, patch: Column) -> Column:
        keys = F.filter(F.array_union(F.map_keys(was), F.map_keys(patch)), lambda k: ~F.coalesce(F.is_variant_null(patch[k]), F.lit(False)))
        inner = lambda k: F.when(F.array_contains(F.map_keys(patch), k), _merged(was[k], patch[k], depth - 1) if depth > 1 else patch[k]).otherwise(was[k])
        return _object(keys, inner)

    merged = lambda o, n, value: F.when(n.isNull(), value).otherwise(objects(F.coalesce(o, _NONE()), n))
    return _bound(lambda a, b: _bound(merged, _members(a), _members(b), b), old, new)


def patched(document: Column, patch: Column, depth: int = DEPTH) -> Column:
    """a JSON document changed by a JSON merge patch, object by object down to ``depth`` levels. Numbers, booleans and arrays keep
    their types; objects come out with sorted keys. A document that is no object counts as empty, a patch that is none as no change."""
    return _bound(
        lambda o, n: F.when(_members(n).isNotNull(), F.to_json(_merged(o, n, depth))).when(_members(o).isNotNull(), F.to_json(o)).otherwise(F.lit("{}")),
        F.try_parse_json(document), F.try_parse_json(patch),
    )


def _without(v: Column, path: list[str]) -> Column:
    key, rest = path[0], path[1:]

    def changed(m: Column, whole: Column) -> Column:
        keys = F.map_keys(m) if rest else F.filter(F.map_keys(m), lambda k: k != key)
        left = _object(keys, lambda k: F.when(k == key, _without(m[k], rest)).otherwise(m[k]) if rest else m[k])
        return F.when(m.isNull(), whole).otherwise(left)

    return _bound(lambda w: _bound(changed, _members(w), w), v)


def without_keys(document: Column, *paths: str) -> Column:
    """a JSON object without some members, each a name or a path (``a.b``); one that is not there changes nothing. Null if no
    member is left or the document is no object."""
    made = F.try_parse_json(document)
    for path in paths:
        made = _without(made, path.split("."))
    return _bound(lambda v: F.when(F.size(_members(v)) > 0, F.to_json(v)), made)


def _with(v: Column, path: list[str], value: Column) -> Column:
    key, rest = path[0], path[1:]

    def changed(m: Column, whole: Column, new: Column) -> Column:
        there = F.array_contains(F.map_keys(m), key)
        if rest:  # a member is set only in an object that is there
            return F.when(F.coalesce(there, F.lit(False)), _object(F.map_keys(m), lambda k: F.when(k == key, _with(m[k], rest, new)).otherwise(m[k]))).otherwise(whole)
        keys = F.array_union(F.map_keys(m), F.array(F.lit(key)))
        return F.when(m.isNull(), whole).otherwise(_object(keys, lambda k: F.when(k == key, new).otherwise(m[k])))

    return _bound(lambda w, new: _bound(changed, _members(w), w, new), v, value)


def with_key(document: Column, path: str, value: Column) -> Column:
    """a JSON document with one member set, by name or path; the value keeps its type. Its parent must be an object that is there,
    else nothing changes; a document that is no object counts as empty."""
    start = _bound(lambda v: F.when(_members(v).isNotNull(), v).otherwise(F.parse_json(F.lit("{}"))), F.try_parse_json(document))
    return F.to_json(_with(start, path.split("."), value.cast("variant")))
