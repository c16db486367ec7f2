"""The URL record: its type, serialization, getters, predicates, equality and part offsets, as columns.

A record's null component is null, an empty one is ``''``. ``error`` is null for a valid URL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlmill.functions import params as P
from urlmill.functions.charsets import SPECIAL

FIELDS = ("href", "scheme", "username", "password", "host", "host_type", "port", "path", "opaque_path", "query", "fragment", "error")
_KINDS = {"port": T.IntegerType(), "opaque_path": T.BooleanType()}
#: The record's type, as an object and as text.
RECORD = T.StructType([T.StructField(n, _KINDS.get(n, T.StringType())) for n in FIELDS])
DDL = RECORD.simpleString()


def _or(c: Column, value: str = "") -> Column:
    return F.coalesce(c, F.lit(value))


def _given(mark: str, c: Column) -> Column:
    """mark + c, or '' for null."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit(mark), c))


def default_port(scheme: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, port in SPECIAL.items():
        if port is not None:
            out = F.when(scheme == name, F.lit(port)).otherwise(out)
    return out


def serialize_parts(u: dict[str, Column]) -> Column:
    """The href of components given as columns."""
    secret = F.when(u["password"] == "", F.lit("")).otherwise(F.concat(F.lit(":"), u["password"]))
    user = F.when((u["username"] == "") & (u["password"] == ""), F.lit("")).otherwise(F.concat(u["username"], secret, F.lit("@")))
    place = F.concat(F.lit("//"), user, u["host"], _given(":", u["port"].cast("string")))
    prefix = F.when(u["host"].isNotNull(), place).when(~u["opaque_path"] & u["path"].startswith("//"), F.lit("/.")).otherwise(F.lit(""))
    return F.concat(u["scheme"], F.lit(":"), prefix, u["path"], _given("?", u["query"]), _given("#", u["fragment"]))


def href(u: Column) -> Column:
    return u["href"]


def protocol(u: Column) -> Column:
    return _or(F.concat(u["scheme"], F.lit(":")))


def username(u: Column) -> Column:
    return _or(u["username"])


def password(u: Column) -> Column:
    return _or(u["password"])


def host(u: Column) -> Column:
    return _or(F.concat(u["host"], _given(":", u["port"].cast("string"))))


def hostname(u: Column) -> Column:
    return _or(u["host"])


def host_type(u: Column) -> Column:
    return u["host_type"]


def port(u: Column) -> Column:
    return _or(u["port"].cast("string"))


def port_int(u: Column) -> Column:
    return F.coalesce(u["port"], F.lit(-1))


def real_port_int(u: Column) -> Column:
    return F.coalesce(u["port"], default_port(u["scheme"]), F.lit(-1))


def path(u: Column) -> Column:
    """Path with the query as it is stored."""
    return _or(F.concat(u["path"], _given("?", u["query"])))


def pathname(u: Column) -> Column:
    return _or(u["path"])


def search(u: Column) -> Column:
    return F.when(_or(u["query"]) == "", F.lit("")).otherwise(F.concat(F.lit("?"), u["query"]))


def hash(u: Column) -> Column:  # noqa: A001
    return F.when(_or(u["fragment"]) == "", F.lit("")).otherwise(F.concat(F.lit("#"), u["fragment"]))


def serialize(u: Column, exclude_fragment: bool = False) -> Column:
    return F.regexp_replace(u["href"], "#.*$", "") if exclude_fragment else u["href"]


def origin(u: Column, blob: Column | None = None) -> Column:
    """blob: the record of the path of ``blob:`` URLs (see ``operators.parse.origins``); without it they have none."""
    own = F.when(u["scheme"].isin("http", "https", "ws", "wss", "ftp"), F.concat(u["scheme"], F.lit("://"), host(u))).otherwise(F.lit("null"))
    if blob is not None:
        inner = F.when(blob["scheme"].isin("http", "https"), F.concat(blob["scheme"], F.lit("://"), host(blob))).otherwise(F.lit("null"))
        own = F.when(u["scheme"] == "blob", inner).otherwise(own)
    return F.when(u["error"].isNull(), own).otherwise(F.lit(""))


def part(u: Column, name: str) -> Column:
    return _or(u[name].cast("string"))


def is_null(u: Column, name: str) -> Column:
    return u[name].isNull()


def is_empty(u: Column, name: str) -> Column:
    return part(u, name) == ""


def is_valid(u: Column) -> Column:
    return u["error"].isNull()


def empty(u: Column) -> Column:
    return _or(u["href"]) == ""


def is_special_scheme(u: Column) -> Column:
    return F.coalesce(u["scheme"].isin(*SPECIAL), F.lit(False))


def is_file_scheme(u: Column) -> Column:
    return F.coalesce(u["scheme"] == "file", F.lit(False))


def is_http_scheme(u: Column) -> Column:
    return F.coalesce(u["scheme"].isin("http", "https"), F.lit(False))


def has_credentials(u: Column) -> Column:
    return (_or(u["username"]) != "") | (_or(u["password"]) != "")


def has_opaque_path(u: Column) -> Column:
    return F.coalesce(u["opaque_path"], F.lit(False))


def can_have_port(u: Column) -> Column:
    return is_valid(u) & (_or(u["host"]) != "") & (u["scheme"] != "file")


def search_params(u: Column) -> Column:
    return P.parse(u["query"])


def with_params(u: Column, params: Column) -> Column:
    """The record with its query rewritten from parameters; no parameter makes it null."""
    query = F.when(F.size(params) > 0, P.to_string(params))
    parts = {n: u[n] for n in FIELDS} | {"query": query}
    valid = is_valid(u)
    return F.struct(*[F.when(valid, serialize_parts(parts)).alias(n) if n == "href" else F.when(valid, query).alias(n) if n == "query" else u[n].alias(n) for n in FIELDS])


def equals(a: Column, b: Column, exclude_fragments: bool = False) -> Column:
    return serialize(a, exclude_fragments) == serialize(b, exclude_fragments)


def url_hash(u: Column) -> Column:
    return F.xxhash64(u["href"])


def part_pos(u: Column, name: str, with_separator: bool = False) -> Column:
    """Where a part begins and ends in the href; absent tail parts are at its end.

    with_separator: the scheme with its ``:``, and query and fragment with their marks unless nothing
    follows these, as in the protocol, search and hash; it makes no difference to other parts.
    """
    n = lambda c: F.coalesce(F.length(c.cast("string")), F.lit(0))
    one = lambda yes: F.when(yes, F.lit(1)).otherwise(F.lit(0))
    scheme_end = n(u["scheme"])
    has_host = u["host"].isNotNull()
    user_begin = scheme_end + 1 + F.when(has_host, 2).otherwise(0)
    user_end = user_begin + n(u["username"])
    has_pass = _or(u["password"]) != ""
    pass_begin = user_end + one(has_pass)
    pass_end = pass_begin + n(u["password"])
    at = pass_end + one(has_credentials(u))
    host_end = at + n(u["host"])
    port_begin = host_end + one(u["port"].isNotNull())
    port_end = port_begin + n(u["port"])
    prefix = F.when(~has_host & ~u["opaque_path"] & u["path"].startswith("//"), 2).otherwise(0)
    path_begin = port_end + prefix
    path_end = path_begin + n(u["path"])
    query_begin = path_end + one(u["query"].isNotNull())
    query_end = query_begin + n(u["query"])
    hash_begin = query_end + one(u["fragment"].isNotNull())
    total = hash_begin + n(u["fragment"])
    bounds = {
        "scheme": (F.lit(0), scheme_end), "username": (user_begin, user_end), "password": (pass_begin, pass_end), "host": (at, host_end),
        "port": (port_begin, port_end), "path": (path_begin, path_end), "query": (query_begin, query_end), "fragment": (hash_begin, total),
    }
    begin, end = bounds[name]
    if with_separator and name == "scheme":
        end = end + one(n(u["scheme"]) > 0)
    if with_separator and name in ("query", "fragment"):
        begin = begin - one(end > begin)
    return F.struct(begin.cast("int").alias("begin"), end.cast("int").alias("end"))
