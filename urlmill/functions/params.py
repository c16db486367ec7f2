"""Query parameters as ``array<struct<name, value>>``: order and duplicates count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from urlmill.functions.encoding import code_units, form_decode, form_encode

TYPE = "array<struct<name:string,value:string>>"


def _c(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def pair(name: Column | str, value: Column | str) -> Column:
    return F.struct(_c(name).alias("name"), _c(value).alias("value"))


def empty() -> Column:
    return F.array().cast(TYPE)


def parse(query: Column, strip_mark: bool = False) -> Column:
    """Parameters of a query; null and empty have none. strip_mark: drop one leading question mark."""
    if strip_mark:
        query = F.regexp_replace(query, "^[?]", "")

    def one(piece: Column) -> Column:
        at = F.instr(piece, "=")
        return pair(form_decode(F.when(at > 0, F.substr(piece, F.lit(1), at - 1)).otherwise(piece)), form_decode(F.when(at > 0, F.substr(piece, at + 1)).otherwise(F.lit(""))))

    return F.coalesce(F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), one), empty())


def append(params: Column, name: Column | str, value: Column | str) -> Column:
    return F.concat(params, F.array(pair(name, value)))


def _same(name: Column | str, value: Column | str | None) -> Callable[[Column], Column]:
    return lambda x: (x["name"] == _c(name)) if value is None else (x["name"] == _c(name)) & (x["value"] == _c(value))


def remove(params: Column, name: Column | str, value: Column | str | None = None) -> Column:
    return remove_if(params, _same(name, value))


delete = remove


def remove_if(params: Column, test: Callable[[Column], Column]) -> Column:
    """Without the pairs that ``test`` (a function of a struct column) accepts."""
    return F.filter(params, lambda x: ~test(x))


def removed(before: Column, after: Column) -> Column:
    return F.size(before) - F.size(after)


def get(params: Column, name: Column | str) -> Column:
    return F.get(F.filter(params, _same(name, None)), F.lit(0))["value"]


def get_all(params: Column, name: Column | str) -> Column:
    return F.transform(F.filter(params, _same(name, None)), lambda x: x["value"])


def has(params: Column, name: Column | str, value: Column | str | None = None) -> Column:
    return F.exists(params, _same(name, value))


def put(params: Column, name: Column | str, value: Column | str) -> Column:
    """Sets the first pair of that name and drops its others; appends if there is none."""
    first = F.array_position(F.transform(params, lambda x: x["name"]), _c(name))
    kept = F.filter(params, lambda x, i: (x["name"] != _c(name)) | (i + 1 == first))
    return F.when(first > 0, F.transform(kept, lambda x: pair(x["name"], F.when(x["name"] == _c(name), _c(value)).otherwise(x["value"])))).otherwise(append(params, name, value))


def sort(params: Column) -> Column:
    """Stable, by name in UTF-16 code unit order."""
    keyed = F.transform(params, lambda x, i: F.struct(code_units(x["name"]).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda x: x["x"])


def to_string(params: Column) -> Column:
    return F.array_join(F.transform(params, lambda x: F.concat(form_encode(x["name"]), F.lit("="), form_encode(x["value"]))), "&")


def size(params: Column) -> Column:
    return F.size(params)
