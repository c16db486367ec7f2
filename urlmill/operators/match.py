"""URL patterns over record columns: test, exec with groups, and routing to many patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlmill.functions.batches import by_row, struct_of
from urlmill.functions.pattern import COMPONENTS, Pattern, PatternError, process

#: Selective components first, since a conjunction stops at the first that fails.
ORDER = ("hostname", "pathname", "protocol", "port", "search", "hash", "username", "password")
ALWAYS = r"^(.*)\z"


def inputs(u: Column) -> dict[str, Column]:
    """What each component's expression is matched against."""
    own = {"protocol": "scheme", "username": "username", "password": "password", "hostname": "host", "port": "port", "pathname": "path", "search": "query", "hash": "fragment"}
    return {k: F.coalesce(u[v].cast("string"), F.lit("")) for k, v in own.items()}


def test(pattern: Pattern, u: Column) -> Column:
    """Whether a record matches; false for a failed one. Components that match anything are left out."""
    out = u["error"].isNull()
    values = inputs(u)
    for name in ORDER:
        regex = pattern.components[name].regex
        if regex != ALWAYS:
            out = out & values[name].rlike(regex)
    return F.coalesce(out, F.lit(False))


def groups(pattern: Pattern, name: str, value: Column) -> Column:
    """``map<string,string>`` of a component's groups; null for a group that took no part."""
    c = pattern.components[name]
    if not c.groups:
        return F.create_map().cast("map<string,string>")
    items = []
    for g in c.groups:
        found = F.regexp_extract(value, c.regex, g.number)
        if g.outer:
            found = F.when(F.regexp_extract(value, c.regex, g.outer) != "", found)
        elif g.empty_is_none:
            found = F.when(found != "", found)
        items += [F.lit(g.name), found]
    return F.create_map(*items)


def execute(pattern: Pattern, u: Column) -> Column:
    """``struct<protocol: struct<input, groups>, ...>``; null without a match."""
    values = inputs(u)
    parts = [F.struct(values[n].alias("input"), groups(pattern, n, values[n]).alias("groups")).alias(n) for n in COMPONENTS]
    return F.when(test(pattern, u), F.struct(*parts))


def route(patterns: dict[str, Pattern], u: Column) -> Column:
    """The names of all patterns that a record matches, in the order given: one pass, no join."""
    hits = [F.when(test(p, u), F.lit(n)) for n, p in patterns.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def first_route(patterns: dict[str, Pattern], u: Column) -> Column:
    return F.coalesce(*[F.when(test(p, u), F.lit(n)) for n, p in patterns.items()])


def init_inputs(init: Column) -> Column:
    """Rows that are dictionaries (a struct of the nine names) as matchable components; null for a bad one."""

    names = ("scheme", "username", "password", "host", "port", "path", "query", "fragment", "error")

    def canonical(r: dict | None) -> tuple:
        try:
            got = dict.fromkeys(COMPONENTS, "") | process({k: v for k, v in (r or {}).items() if isinstance(v, str)}, pattern=False)
            return (*[got[c] for c in COMPONENTS], None)
        except PatternError as e:
            return (*[None] * len(COMPONENTS), str(e))

    return by_row(struct_of(**dict.fromkeys(names, T.StringType())), canonical)(F.lit(True), init)
