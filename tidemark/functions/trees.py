"""Whole JSON trees in expressions: each function walks a VARIANT to a given depth and builds one expression for all of it.

A walk of any depth is one nested lambda a level, so rows are never taken apart, and nothing leaves the JVM.  Containers below
the depth are not entered; every function says what it makes of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scalars

#: Levels of containers that are entered.
DEPTH = 8
#: The type of a walk.
NODES = "array<struct<path:string,key:string,shape:string,kind:string,text:string>>"


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, BIGINT, DECIMAL, DOUBLE, VOID, …; of a container without looking at what is in it."""
    scalar = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return F.when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), "OBJECT").when(F.try_variant_get(v, "$", "array<variant>").isNotNull(), "ARRAY").otherwise(scalar)


def shape(v: Column) -> Column:
    """object, array or scalar."""
    return _shape(kind(v))


def _shape(what: Column) -> Column:
    return scalars.once(what, lambda w: F.when(w == "OBJECT", "object").when(w == "ARRAY", "array").otherwise("scalar"))


def children(v: Column) -> Column:
    """(label, key, value) of the members of an object, in order of their keys, or of the items of a list; none of a scalar."""
    by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    fields = F.array_sort(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), by_key)
    of_object = F.transform(fields, lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("label"), e["key"].alias("key"), e["value"].alias("value")))
    of_list = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("label"), F.lit(None).cast("string").alias("key"), x.alias("value")))
    return F.coalesce(of_object, of_list)  # each is null of anything else


def _kind(v: Column, below: Column) -> Column:
    """As ``kind``, by the children where there are any: taking a container apart again writes all of it anew."""
    first = F.get(below, F.lit(0))["key"]
    return F.when(below.isNull(), F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)).when(F.size(below) == 0, kind(v)).when(first.isNull(), "ARRAY").otherwise("OBJECT")


def walk(v: Column, depth: int = DEPTH, path: Column | None = None, key: Column | None = None) -> Column:
    """Every node of a tree as (path, key, shape, kind, text), the root first; ``key`` is the nearest one above for items.

    ``text`` is the value of a string, null for all else.  A container that is not entered has the kind DEEP.
    """
    path, key = F.lit("$") if path is None else path, F.lit(None).cast("string") if key is None else key
    deep = lambda what: F.when((what == "OBJECT") | (what == "ARRAY"), "DEEP").otherwise(what) if depth == 0 else what
    node = lambda what: F.struct(path.alias("path"), key.alias("key"), _shape(what).alias("shape"), deep(what).alias("kind"), F.when(what == "STRING", F.try_variant_get(v, "$", "string")).alias("text"))
    if depth == 0:
        return F.transform(F.array(kind(v)), node)
    below = lambda cs: F.flatten(F.transform(cs, lambda c: walk(c["value"], depth - 1, F.concat(path, c["label"]), F.coalesce(c["key"], key))))
    return scalars.once(children(v), lambda cs: F.concat(F.transform(F.array(_kind(v, cs)), node), F.coalesce(below(cs), F.array().cast(NODES))))


def quoted(text: Column) -> Column:
    """A text as JSON."""
    return scalars.once(F.to_json(F.struct(text.alias("x"))), lambda inner: F.substring(inner, F.lit(6), F.length(inner) - 6))


def _name(name: str) -> Column:
    """A fixed name as JSON: an expression without a lambda, which is worked out when the query is planned."""
    inner = F.to_json(F.struct(F.lit(name).alias("x")))
    return F.substring(inner, F.lit(6), F.length(inner) - 6)


def rendered(v: Column, member: Callable[[Column, int], Column], depth: int = DEPTH) -> Column:
    """An object as JSON with sorted keys, of what ``member`` makes of each (label, key, value): a text, or null to leave it out.
    ``member`` gets the levels that are left."""
    parts = F.transform(children(v), lambda c: F.concat(quoted(c["key"]), F.lit(":"), member(c, depth - 1)))
    return F.concat(F.lit("{"), F.array_join(F.filter(parts, lambda p: p.isNotNull()), ","), F.lit("}"))


# ------------------------------------------------------------------------------------------------- the canonical form

#: Digits of a number, items of a list and characters of a text that a bounded document keeps.
DIGITS, ITEMS, CHARACTERS = 6, 10, 200


def _number(x: Column) -> Column:
    """A double to six digits; NaN and infinity fail, as no hash must cover them."""
    bad = lambda y: F.isnan(y) | (F.abs(y) == float("inf"))
    return scalars.once(x, lambda y: F.when(bad(y), F.raise_error(F.lit("NaN and infinity have no canonical form")).cast("double")).otherwise(F.round(y, DIGITS) + F.lit(0.0)))


def canonical(value: Column, kind_: T.DataType, bounded: bool = False, depth: int = DEPTH) -> Column:
    """The canonical JSON of a column of any type: keys sorted at every depth, doubles to six digits, nulls kept, NaN refused.

    The type is walked and one expression comes out.  Maps are objects; their keys must be strings.  bounded: lists keep their
    first items and texts their first characters.  Variants are walked to ``depth``; a deeper one fails.  (Planning a query takes
    longer with every level.)
    """
    null = lambda text: F.coalesce(text, F.lit("null"))
    joined = lambda parts, a, b: F.concat(F.lit(a), F.array_join(parts, ","), F.lit(b))
    if isinstance(kind_, T.StructType):
        null = lambda text: F.when(value.isNull(), F.lit("null")).otherwise(text)
        parts = [F.concat(_name(f.name), F.lit(":"), canonical(value[f.name], f.dataType, bounded, depth)) for f in sorted(kind_.fields, key=lambda f: f.name.encode())]
        return null(joined(F.array(*parts) if parts else F.array().cast("array<string>"), "{", "}"))
    if isinstance(kind_, T.ArrayType):
        held = F.slice(value, 1, ITEMS) if bounded else value
        return null(joined(F.transform(held, lambda x: canonical(x, kind_.elementType, bounded, depth)), "[", "]"))
    if isinstance(kind_, T.MapType):
        if not isinstance(kind_.keyType, T.StringType):
            raise TypeError("keys of a map must be strings")
        written = lambda m: F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(quoted(k), F.lit(":"), canonical(F.element_at(m, k), kind_.valueType, bounded, depth)))
        return null(scalars.once(value, lambda m: joined(written(m), "{", "}")))
    if isinstance(kind_, T.VariantType):
        return null(scalars.once(value, lambda v: _canonical_variant(v, bounded, depth)))
    if isinstance(kind_, (T.DoubleType, T.FloatType)):
        return null(_written(_number(value.cast("double"))))
    if isinstance(kind_, T.StringType):
        return F.when(value.isNull(), F.lit("null")).otherwise(quoted(F.substring(value, 1, CHARACTERS) if bounded else value))
    if isinstance(kind_, (T.BooleanType, T.IntegralType)):
        return null(value.cast("string"))
    if isinstance(kind_, T.DecimalType):
        return null(_written(_number(value.cast("double"))))
    raise TypeError(f"no canonical form of {kind_.simpleString()}")


def _written(x: Column) -> Column:
    """A double as JSON writes it: 1.5, 2.0, 1.0E10 as plain digits where it has few."""
    whole = lambda y: (y == F.floor(y)) & (F.abs(y) < 1e15)
    return scalars.once(x, lambda y: F.when(whole(y), F.concat(y.cast("bigint").cast("string"), F.lit(".0"))).when(F.abs(y) < 1e15, F.rtrim(y.cast("decimal(38,6)").cast("string"), F.lit("0"))).otherwise(y.cast("string")))


def _canonical_variant(v: Column, bounded: bool, depth: int) -> Column:
    return scalars.once(children(v), lambda below: scalars.once(_kind(v, below), lambda what: _variant_of(v, what, below, bounded, depth)))


def _variant_of(v: Column, what: Column, members_: Column, bounded: bool, depth: int) -> Column:
    text = F.try_variant_get(v, "$", "string")
    scalar = F.when(what == "VOID", F.lit("null")).when(what == "STRING", quoted(F.substring(text, 1, CHARACTERS) if bounded else text)).when(what.isin("DOUBLE", "FLOAT", "DECIMAL"), _written(_number(F.try_variant_get(v, "$", "double")))).otherwise(F.to_json(v))
    if depth == 0:
        return F.when(what.isin("OBJECT", "ARRAY"), F.raise_error(F.lit("a document is deeper than its canonical form goes")).cast("string")).otherwise(scalar)
    members_ = F.slice(members_, 1, F.when(what == "ARRAY", ITEMS).otherwise((1 << 31) - 1)) if bounded else members_
    parts = F.transform(members_, lambda c: F.concat(F.when(c["key"].isNotNull(), F.concat(quoted(c["key"]), F.lit(":"))).otherwise(F.lit("")), _canonical_variant(c["value"], bounded, depth - 1)))
    # The parts stand once in the expression: it would double with every level otherwise.
    return F.coalesce(F.concat(F.when(what == "OBJECT", "{").otherwise("["), F.array_join(parts, ","), F.when(what == "OBJECT", "}").otherwise("]")), scalar)


def truncated(value: Column, kind_: T.DataType) -> Column:
    """Whether bounding the fields of a struct leaves anything out at its top level."""
    if not isinstance(kind_, T.StructType):
        raise TypeError("a struct is needed")
    cut = [F.coalesce(F.size(value[f.name]) > ITEMS, F.lit(False)) for f in kind_.fields if isinstance(f.dataType, T.ArrayType)]
    cut += [F.coalesce(F.length(value[f.name]) > CHARACTERS, F.lit(False)) for f in kind_.fields if isinstance(f.dataType, T.StringType)]
    out = F.lit(False)
    for c in cut:
        out = out | c
    return out
