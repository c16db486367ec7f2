"""Parsing columns of URLs: native expressions for ordinary rows, the Arrow-batched kernel for the rest.

Both ways are columns of one pass. The kernel is handed null in place of an ordinary row and gives null for it
at once, so such rows cost Python nothing but their place in a batch; nothing is read twice.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlmill.functions import idna, kernel
from urlmill.functions.batches import by_row, struct_of
from urlmill.functions.charsets import FRAGMENT, PATH, SPECIAL_QUERY, USERINFO
from urlmill.functions.encoding import percent_encode
from urlmill.functions.record import DDL, FIELDS, RECORD, default_port, is_special_scheme, origin, serialize_parts

#: Ordinary rows: printable ASCII, a special scheme with ``//``, no user, a plain domain (no encoded label, no number in the end), no backslash.
ORDINARY = (
    r"^(?i:https?|wss?|ftp)://(?!(?i:[^/?#:]*\.)?(?i:xn--))(?!(?:[^/?#:]*\.)?(?i:[0-9]+|0x[0-9a-f]*)\.?(?:[/?#:]|\z))"
    r"[A-Za-z0-9._~!$&'()*+,;=-]+(?::(?:0*[0-9]{0,4}|0*[1-5][0-9]{4}|0*6[0-4][0-9]{3}|0*65[0-4][0-9]{2}|0*655[0-2][0-9]|0*6553[0-5]))?(?:[/?#][ -\[\]-~]*)?\z"
)
#: Hosts by themselves that are plain domains.
PLAIN_HOST = r"^[A-Za-z0-9._~!$&'()*+,;=-]+\z"


def row_of(url: kernel.Url) -> tuple:
    return (url.href(), url.scheme, url.username, url.password, url.host, url.host_type, url.port, url.path, url.opaque, url.query, url.fragment, None)


def failed(code: str) -> tuple:
    return (None,) * 11 + (code,)


def record_of(text: str | None, base: str | None = None) -> tuple:
    try:
        return row_of(kernel.parse_with_base(text, base))
    except kernel.UrlError as e:
        return failed(str(e))


_parse = by_row(RECORD, record_of)


def url_parse(text: Column, base: Column | None = None, where: Column | None = None) -> Column:
    """Records by the kernel: complete, for any row. A base that fails gives its own code. where: null elsewhere."""
    go = F.lit(True) if where is None else where
    return _parse(go, text) if base is None else _parse(go, text, base)


def trimmed(text: Column) -> Column:
    odd = text.rlike(r"^[\x00-\x20]|[\t\n\r]|[\x00-\x20]\z")
    return F.when(odd, F.regexp_replace(F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")).otherwise(text)


def is_ordinary(text: Column) -> Column:
    """Whether the native expressions cover a (trimmed) text."""
    return F.coalesce(text.rlike(ORDINARY), F.lit(False))


def _walked(path: Column) -> Column:
    """A path without dot segments; only paths that have some are walked."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    none = F.array().cast("array<string>")
    two, one = r"^(?i)(\.|%2e){2}$", r"^(?i)(\.|%2e)$"
    steps = F.aggregate(parts, none, lambda done, x: F.when(x.rlike(two), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x.rlike(one), done).otherwise(F.concat(done, F.array(x))))
    last = F.element_at(parts, -1)
    full = F.when(last.rlike(two) | last.rlike(one), F.concat(steps, F.array(F.lit("")))).otherwise(steps)
    return F.when(path.rlike(r"(?i)/(\.|%2e)"), F.concat(F.lit("/"), F.array_join(full, "/"))).otherwise(path)


def _behind(text: Column, before: Column, mark: str) -> Column:
    """What follows ``before`` and a mark in a text; null without the mark."""
    return F.when(F.instr(text, mark) > 0, F.substr(text, F.length(before) + 2))


#: The parts of an ordinary text ``t``, step by step: each step is made of columns of those before.
STEPS: tuple[Callable[[Callable[[str], Column]], dict[str, Column]], ...] = (
    lambda c: {"scheme": F.lower(F.substring_index(c("t"), ":", 1)), "rest": F.substr(c("t"), F.instr(c("t"), "://") + 3)},
    lambda c: {"body": F.substring_index(c("rest"), "#", 1)},
    lambda c: {"front": F.substring_index(c("body"), "?", 1), "fragment": percent_encode(_behind(c("rest"), c("body"), "#"), FRAGMENT)},
    lambda c: {"place": F.substring_index(c("front"), "/", 1), "query": percent_encode(_behind(c("body"), c("front"), "?"), SPECIAL_QUERY)},
    lambda c: {
        "host": F.lower(F.substring_index(c("place"), ":", 1)),
        "raw": percent_encode(F.when(c("front") == c("place"), F.lit("/")).otherwise(F.substr(c("front"), F.length(c("place")) + 1)), PATH),
    },
    lambda c: {"number": _behind(c("place"), c("host"), ":").try_cast("int"), "path": _walked(c("raw"))},
    lambda c: {"port": F.when(c("number") == default_port(c("scheme")), F.lit(None).cast("int")).otherwise(c("number"))},
)


def _ordinary_record(c: Callable[[str], Column]) -> Column:
    known = {n: c(n) for n in ("scheme", "host", "port", "path", "query", "fragment")}
    return _record(known | {"username": F.lit(""), "password": F.lit(""), "host_type": F.lit("Domain"), "opaque_path": F.lit(False), "error": F.lit(None).cast("string")})


def native_parse(text: Column) -> Column:
    """Records of ordinary (trimmed) texts, by built-in expressions only."""
    parts = {"t": text}
    for step in STEPS:
        parts |= step(parts.__getitem__)
    return _ordinary_record(parts.__getitem__)


def with_native(df: DataFrame, text: str, to: str) -> DataFrame:
    """``df`` with the records of a column of ordinary texts; null for null. Each part is a column of its own, made once."""
    column = lambda n: F.col(text) if n == "t" else F.col(f"__{n}")
    made, names = df, []
    for step in STEPS:
        parts = {f"__{n}": c for n, c in step(column).items()}
        names += parts
        made = made.withColumns(parts)
    return made.withColumn(to, F.when(F.col(text).isNotNull(), _ordinary_record(column))).drop(*names)


def _record(own: dict[str, Column]) -> Column:
    """A record of its parts."""
    return F.struct(*[(serialize_parts(own) if n == "href" else own[n]).alias(n) for n in FIELDS]).cast(DDL)


def parse_urls(df: DataFrame, text: str, to: str = "url_record", route: bool = True) -> DataFrame:
    """``df`` with a record per row. route=False sends every row to the kernel."""
    if not route:
        return df.withColumn(to, url_parse(F.col(text)))
    cleaned = df.withColumn("__clean", trimmed(F.col(text)))
    easy = cleaned.withColumn("__easy", F.when(is_ordinary(F.col("__clean")), F.col("__clean"))).drop("__clean")
    hard = easy.withColumn("__hard", url_parse(F.col(text), where=F.col("__easy").isNull()))
    return with_native(hard, "__easy", "__native").withColumn(to, F.coalesce("__native", "__hard")).drop("__easy", "__hard", "__native")


def can_parse(text: Column, base: Column | None = None) -> Column:
    """Whether a text is a URL; an ordinary text is one, whatever valid base it has."""
    easy = is_ordinary(trimmed(text))
    if base is not None:
        easy = easy & (base.isNull() | is_ordinary(trimmed(base)))
    return easy | F.coalesce(url_parse(text, base, ~easy)["error"].isNull(), F.lit(False))


def strict_parse(text: Column, base: Column | None = None) -> Column:
    """As ``url_parse``, but a failure stops the query with its code."""
    record = url_parse(text, base)
    return F.when(record["error"].isNull(), record).otherwise(F.raise_error(F.concat(F.lit("URL parse error: "), record["error"])).cast(DDL))


def absolute(link: Column, base: Column) -> Column:
    """The absolute text of a (trimmed) link on the record of an ordinary base; what it can't tell is no ordinary text."""
    place = F.concat(base["scheme"], F.lit("://"), base["host"], F.when(base["port"].isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), base["port"].cast("string"))))
    query = F.when(base["query"].isNull(), F.lit("")).otherwise(F.concat(F.lit("?"), base["query"]))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(base["scheme"], F.lit(":"), link))
        .when(link.startswith("/"), F.concat(place, link))
        .when(link.startswith("?"), F.concat(place, base["path"], link))
        .when((link == "") | link.startswith("#"), F.concat(place, base["path"], query, link))
        .otherwise(F.concat(place, F.regexp_replace(base["path"], "[^/]*$", ""), link))
    )


def resolve_links(df: DataFrame, link: str, base: str, to: str = "url_record") -> DataFrame:
    """``df`` with the record of each link on its base. Ordinary links on ordinary bases are resolved by
    built-in expressions, the others by the kernel; a null base is none."""
    cleaned = df.withColumn("__base", trimmed(F.col(base))).withColumn("__link", trimmed(F.col(link)))
    based = with_native(cleaned.withColumn("__base", F.when(is_ordinary(F.col("__base")), F.col("__base"))), "__base", "__on")
    # a scheme without // may stand for a relative link, and is left to the kernel by is_ordinary
    whole = based.withColumn("__whole", F.when(F.col("__on").isNotNull(), absolute(F.col("__link"), F.col("__on"))))
    easy = whole.withColumn("__whole", F.when(is_ordinary(F.col("__whole")), F.col("__whole"))).drop("__base", "__link", "__on")
    hard = easy.withColumn("__hard", url_parse(F.col(link), F.col(base), F.col("__whole").isNull()))
    return with_native(hard, "__whole", "__native").withColumn(to, F.coalesce("__native", "__hard")).drop("__whole", "__hard", "__native")


def origins(df: DataFrame, record: str = "url_record", to: str = "origin") -> DataFrame:
    """Origins, with those inside ``blob:`` URLs; only these go to the kernel again."""
    u = F.col(record)
    inner = df.withColumn("__inner", url_parse(u["path"], where=u["scheme"] == "blob"))
    return inner.withColumn(to, origin(u, F.col("__inner"))).drop("__inner")


def _plain_domain(text: Column) -> Column:
    """Whether a text is a host that is itself in lower case: no number in the end, no encoded label."""
    low = F.lower(text)
    return text.rlike(PLAIN_HOST) & ~low.rlike(r"(^|\.)xn--") & ~low.rlike(r"(^|\.)([0-9]+|0x[0-9a-f]*)\.?$")


def _changes(u: Column, part: str, value: Column) -> tuple[Column, dict[str, Column], Column]:
    """Setting a part by built-in expressions: whether a (valid) record and a printable ASCII value are
    covered, the parts that change, and whether the value is accepted."""
    none, yes = F.lit(None).cast("string"), F.lit(True)
    web = is_special_scheme(u) & (u["scheme"] != "file") & (u["host"] != "")
    placed = (F.coalesce(u["host"], F.lit("")) != "") & (u["scheme"] != "file")
    if part == "hash":
        return yes, {"fragment": F.when(value != "", percent_encode(F.regexp_replace(value, "^#", ""), FRAGMENT))}, yes
    if part == "search":
        return is_special_scheme(u), {"query": F.when(value != "", percent_encode(F.regexp_replace(value, r"^\?", ""), SPECIAL_QUERY))}, yes
    if part in ("username", "password"):
        return yes, {part: F.when(placed, percent_encode(value, USERINFO)).otherwise(u[part])}, placed
    if part == "pathname":
        return web & ~value.contains("\\"), {"path": _walked(percent_encode(F.concat(F.lit("/"), F.regexp_replace(value, "^/", "")), PATH))}, yes
    if part == "port":
        digits = F.regexp_replace(F.regexp_extract(value, "^([0-9]*)", 1), "^0+(?=.)", "")
        number = F.when(F.length(digits) <= 5, digits.try_cast("int"))
        good = placed & ((value == "") | F.coalesce(number <= 65535, F.lit(False)))
        return yes, {"port": F.when(~good, u["port"]).when((value == "") | (number == default_port(u["scheme"])), F.lit(None).cast("int")).otherwise(number)}, good
    if part == "protocol":
        scheme = F.lower(F.regexp_extract(value, r"^([A-Za-z][A-Za-z0-9+.\-]*)(?::|\z)", 1))
        crossing = scheme.isin("http", "https", "ws", "wss", "ftp", "file") != is_special_scheme(u)
        to_file = (scheme == "file") & ((u["username"] != "") | (u["password"] != "") | u["port"].isNotNull())
        from_file = (u["scheme"] == "file") & (F.coalesce(u["host"], F.lit("")) == "")
        good = (scheme != "") & ~crossing & ~to_file & ~from_file
        port = F.when(good & (u["port"] == default_port(scheme)), F.lit(None).cast("int")).otherwise(u["port"])
        return yes, {"scheme": F.when(good, scheme).otherwise(u["scheme"]), "port": port}, good
    if part == "hostname":
        return web & _plain_domain(value), {"host": F.lower(value), "host_type": F.lit("Domain")}, yes
    if part == "host":
        name, digits = F.regexp_extract(value, "^([^:]*)", 1), F.regexp_extract(value, ":([0-9]+)$", 1)
        number = digits.try_cast("int")
        port = F.when(digits == "", u["port"]).when(number == default_port(u["scheme"]), F.lit(None).cast("int")).otherwise(number)
        easy = value.rlike("^[^:]+(:[0-9]{1,5})?\\z") & _plain_domain(name) & ((digits == "") | (number <= 65535))
        return web & easy, {"host": F.lower(name), "host_type": F.lit("Domain"), "port": port}, yes
    return F.lit(False), {"fragment": none}, yes


def _set_by_kernel(part: str):
    kind = struct_of(url=RECORD, accepted=T.BooleanType())

    def change(r: dict | None, value: str | None) -> tuple:
        r = r or dict.fromkeys(FIELDS)
        valid = r["error"] is None and r["href"] is not None
        parts = [r[n] for n in FIELDS[1:-1]]
        url = kernel.Url(*parts[:7], bool(parts[7]), *parts[8:]) if valid else kernel.Url()
        done = value is not None and (valid or part == "href") and kernel.SETTERS[part](url, value)
        return (row_of(url) if valid or done else failed(r["error"])), bool(done)

    return by_row(kind, change)


def set_part(record: Column, part: str, value: Column) -> Column:
    """``struct(url, accepted)`` after setting a part (``href protocol username password host hostname port
    pathname search hash``); a failed record refuses all but ``href``.

    Ordinary values are set by built-in expressions, the others by the kernel.
    """
    if part not in kernel.SETTERS:
        raise ValueError(f"no such part: {part}")
    if part == "href":
        clean = trimmed(value)
        easy = is_ordinary(clean)
        own = F.struct(native_parse(clean).alias("url"), F.lit(True).alias("accepted"))
    else:
        covered, changes, accepted = _changes(record, part, value)
        easy = F.coalesce(record["error"].isNull() & record["href"].isNotNull() & value.rlike(r"^[ -~]*\z") & covered, F.lit(False))
        own = F.struct(_record({n: changes.get(n, record[n]) for n in FIELDS}).alias("url"), accepted.alias("accepted"))
    return F.when(easy, own).otherwise(_set_by_kernel(part)(~easy, record, value))


def _host_of(text: str) -> tuple:
    try:
        return (*kernel.parse_host(text), None) if text else (None, None, "host_missing")
    except kernel.UrlError as e:
        return None, None, str(e)


_HOST = struct_of(host=T.StringType(), host_type=T.StringType(), error=T.StringType())
_parse_host = by_row(_HOST, lambda t: _host_of(t or ""))


def url_host(text: Column) -> Column:
    """``struct(host, host_type, error)`` of a host by itself, as in a special URL; plain domains by built-in expressions."""
    easy = F.coalesce(_plain_domain(text), F.lit(False))
    own = F.struct(F.lower(text).alias("host"), F.lit("Domain").alias("host_type"), F.lit(None).cast("string").alias("error"))
    return F.when(easy, own).otherwise(_parse_host(~easy, text))


def domain_to_ascii(text: Column, strict: bool = False, check_hyphens: bool | None = None, std3: bool | None = None, dns_length: bool | None = None) -> Column:
    """The ASCII form of a domain; null on failure. The last three, by default as ``strict`` says, can be chosen one by one."""
    rules = idna.options(strict, check_hyphens, std3, dns_length)
    return by_row(T.StringType(), lambda t: idna.to_ascii(t, rules))(text.isNotNull(), text)


def domain_to_unicode(text: Column, strict: bool = False) -> Column:
    """``struct(value, ok, faults)``: the Unicode form, whether it is without fault, and the names of the faults met."""
    kind = struct_of(value=T.StringType(), ok=T.BooleanType(), faults=T.ArrayType(T.StringType()))
    rules = idna.options(strict)

    def convert(t: str) -> tuple:
        value, faults = idna.to_unicode(t, rules)
        return value, not faults, sorted(faults)

    return by_row(kind, convert)(text.isNotNull(), text)


def nfc(text: Column) -> Column:
    """Canonical composition; ASCII is in that form already."""
    easy = F.coalesce(text.rlike(r"^[\x00-\x7F]*\z"), F.lit(True))
    return F.when(easy, text).otherwise(by_row(T.StringType(), lambda t: unicodedata.normalize("NFC", t))(~easy, text))


def _ipv6_of(text: str | None) -> tuple:
    try:
        own = kernel.ipv6(text or "")
        return own, kernel.ipv6_text(own), None
    except kernel.UrlError as e:
        return None, None, str(e)


_parse_ipv6 = by_row(struct_of(pieces=T.ArrayType(T.IntegerType()), text=T.StringType(), error=T.StringType()), _ipv6_of)


def ipv6_canonical(text: Column) -> Column:
    """``struct(pieces, text, error)`` of an IPv6 address without brackets."""
    return _parse_ipv6(F.lit(True), text)


def ipv4_value(text: Column) -> Column:
    """The value of an IPv4 address in any spelling, as BIGINT; null if it is none. Built-in expressions only."""
    parts = F.split(F.regexp_replace(text, r"(?<=.)\.\z", ""), r"\.")

    def value(p: Column) -> Column:
        hexed = F.when(F.length(p) == 2, F.lit("0")).otherwise(F.substr(p, F.lit(3)))
        small = lambda x: F.length(F.regexp_replace(x, "^0+", "")) <= 11
        return (
            F.when(p.rlike("^0[xX][0-9A-Fa-f]*$") & small(hexed), F.conv(hexed, 16, 10).try_cast("bigint"))
            .when(p.rlike("^0[0-7]*$") & small(p), F.conv(p, 8, 10).try_cast("bigint"))
            .when(p.rlike("^[1-9][0-9]*$") & small(p), p.try_cast("bigint"))
        )

    values = F.transform(parts, value)
    n = F.size(parts)
    good = (n <= 4) & F.forall(values, lambda v: v.isNotNull()) & F.forall(F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda v: v <= 255)
    last = F.element_at(values, -1)
    room = F.when(n == 1, F.lit(2**32)).when(n == 2, F.lit(2**24)).when(n == 3, F.lit(2**16)).otherwise(F.lit(256))
    shifted = lambda v, i: F.when(i == 0, v * 2**24).when(i == 1, v * 2**16).otherwise(v * 2**8)
    before = F.transform(F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(0))), shifted)
    head = F.aggregate(before, F.lit(0).cast("bigint"), lambda a, v: a + v)
    return F.when(F.coalesce(good & (last < room), F.lit(False)), last + head)


def ipv4_text(value: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(value, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def register(spark) -> None:
    """The record functions by name, for SQL: ``url_parse(text)`` and ``url_parse_base(text, base)``."""
    text = lambda f: by_row(RECORD, f)
    spark.udf.register("__url_parse", text(record_of))
    record = DDL.replace("struct<", "STRUCT<", 1)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION url_parse(t STRING) RETURNS {record} RETURN __url_parse(true, t)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION url_parse_base(t STRING, b STRING) RETURNS {record} RETURN __url_parse(true, t, b)")
