"""Registered queries on hard cases, each with the answer that the rules prescribe.

A case is a template; ``{n}`` in its inputs and answers stands for a page's id, so every page asks one
case and no answer is a constant of the plan. The SQL states the answers, it parses nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlmill.functions import encoding as E
from urlmill.functions import params as P
from urlmill.functions import record as R
from urlmill.functions.pattern import compile_pattern
from urlmill.operators import filepath, match, parse, suffixes
from urlmill.sources import links
from urlmill.streaming import urls as streams

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

Value = str | int | bool | None


def _quoted(x: Value) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, int):
        return str(x)
    plain = x.replace("'", "''")
    return "'" + plain + "'" if x.isprintable() else " || ".join(f"'{c}'" if c.isprintable() and c != "'" else f"chr({ord(c)})" for c in x)


def _kind(values: list[Value]) -> str:
    known = next((x for x in values if x is not None), "")
    return "boolean" if isinstance(known, bool) else "int" if isinstance(known, int) else "string"


def _ask_cases(rows: list[tuple[Value, ...]], ask: Callable[..., tuple[Column, ...]], names: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
        which = (F.col("page_id") % len(rows)).cast("int")
        for i, values in enumerate(zip(*rows)):
            picked = F.get(F.array(*[F.lit(x).cast("string") for x in values]), which)
            own = own.withColumn(f"__{i}", F.replace(picked, F.lit("{n}"), F.col("page_id").cast("string")))
        got = ask(*[F.col(f"__{i}") for i in range(len(rows[0]))])
        return own.select("page_id", *[c.alias(n) for n, c in zip(names, got)])

    return run


def _answers_sql(answers: list[tuple[Value, ...]], names: tuple[str, ...]) -> str:
    columns = []
    for name, values in zip(names, zip(*answers)):
        picked = f"[{', '.join(map(_quoted, values))}][1 + page_id % {len(answers)}]"
        kind = _kind(list(values))
        whole = f"replace({picked}, '{{n}}', page_id::VARCHAR)" if kind == "string" else f"({picked})::{'INTEGER' if kind == 'int' else 'BOOLEAN'}"
        columns.append(f"{whole} AS {name}")
    return f"SELECT page_id, {', '.join(columns)} FROM pages"


#: The answers' column names of each query.
_NAMES: dict[str, tuple[str, ...]] = {}


def on_cases(name: str, names: str, rows: dict[tuple[Value, ...], tuple[Value, ...]]) -> Callable:
    """Registers a query. rows: from inputs to answers; the decorated function: from columns of the inputs to those of the answers."""

    def keep(ask: Callable[..., tuple[Column, ...]]) -> Callable:
        _NAMES[name] = tuple(names.split())
        _Q[name] = _ask_cases(list(rows), ask, _NAMES[name])
        _SQL[name] = _answers_sql(list(rows.values()), _NAMES[name])
        return ask

    return keep


def _error(u: Column) -> tuple[Column, Column]:
    return u["href"], u["error"]


# Relative references, authorities, files and opaque paths

_BASE = "http://u:p@site{n}.test:81/a/b?q=1"
_RELATIVE = {
    ("http:c/d", _BASE): ("http://u:p@site{n}.test:81/a/c/d", None),
    ("https:c{n}", _BASE): ("https://c{n}/", None),
    ("http:", _BASE): ("http://u:p@site{n}.test:81/a/b?q=1", None),
    ("http:?z", _BASE): ("http://u:p@site{n}.test:81/a/b?z", None),
    ("", _BASE): ("http://u:p@site{n}.test:81/a/b?q=1", None),
    ("?z={n}", _BASE): ("http://u:p@site{n}.test:81/a/b?z={n}", None),
    ("#z", _BASE): ("http://u:p@site{n}.test:81/a/b?q=1#z", None),
    ("c", _BASE): ("http://u:p@site{n}.test:81/a/c", None),
    ("../../../c", _BASE): ("http://u:p@site{n}.test:81/c", None),
    ("./c/.", _BASE): ("http://u:p@site{n}.test:81/a/c/", None),
    ("/r", _BASE): ("http://u:p@site{n}.test:81/r", None),
    ("\\r\\s", _BASE): ("http://u:p@site{n}.test:81/r/s", None),
    ("//o{n}.test/p", _BASE): ("http://o{n}.test/p", None),
    ("\\\\o{n}.test\\p", _BASE): ("http://o{n}.test/p", None),
    ("/\\o{n}.test", _BASE): ("http://o{n}.test/", None),
    ("c", "mailto:x{n}"): (None, "missing_scheme_non_relative_url"),
    ("#c", "mailto:x{n}"): ("mailto:x{n}#c", None),
    ("c", "tag:/a/b{n}"): ("tag:/a/c", None),
    ("//h{n}/c", "tag:/a/b"): ("tag://h{n}/c", None),
    ("c", "http://a b/"): (None, "domain_invalid_code_point"),
    ("http://k{n}/", "no base"): (None, "missing_scheme_non_relative_url"),
}


@on_cases("resolve_relative", "href error", _RELATIVE)
def _relative(link: Column, base: Column) -> tuple[Column, ...]:
    return _error(parse.url_parse(link, base))


@on_cases("url_authority", "href error", {
    ("http:///////o{n}.test",): ("http://o{n}.test/", None),
    ("https:\\/\\o{n}.test/x",): ("https://o{n}.test/x", None),
    ("ws:o{n}.test",): ("ws://o{n}.test/", None),
    ("http://a@b@o{n}.test/",): ("http://a%40b@o{n}.test/", None),
    ("http://a:b:c@o{n}.test/",): ("http://a:b%3Ac@o{n}.test/", None),
    ("http://:@o{n}.test/",): ("http://o{n}.test/", None),
    ("http://a@/{n}",): (None, "host_missing"),
    ("http://:8{n}/",): (None, "host_missing"),
    ("http://o{n}.test:0080/",): ("http://o{n}.test/", None),
    ("http://o{n}.test:/",): ("http://o{n}.test/", None),
    ("https://o{n}.test:080/",): ("https://o{n}.test:80/", None),
    ("x-y://o{n}",): ("x-y://o{n}", None),
    ("x-y://o{n}:7/a",): ("x-y://o{n}:7/a", None),
    ("x-y:///a{n}",): ("x-y:///a{n}", None),
})
def _authority(text: Column) -> tuple[Column, ...]:
    return _error(parse.url_parse(text))


@on_cases("url_file", "href host error", {
    ("file:x/{n}", None): ("file:///x/{n}", "", None),
    ("file:", None): ("file:///", "", None),
    ("file:f{n}", "file:///d/e"): ("file:///d/f{n}", "", None),
    ("file:?z", "file:///d/e{n}?q"): ("file:///d/e{n}?z", "", None),
    ("file:#z", "file:///d/e{n}?q"): ("file:///d/e{n}?q#z", "", None),
    ("file:W|/w{n}", "file:///d/e"): ("file:///W:/w{n}", "", None),
    ("/m{n}", "file:///K:/a/b"): ("file:///K:/m{n}", "", None),
    ("\\m{n}", "file:///K:/a/b"): ("file:///K:/m{n}", "", None),
    ("/m{n}", "file://srv/a"): ("file://srv/m{n}", "srv", None),
    ("../../../m{n}", "file:///K:/a/b"): ("file:///K:/m{n}", "", None),
    ("/Q:/m{n}", "file:///K:/a"): ("file:///Q:/m{n}", "", None),
    ("file://localhost/m{n}", None): ("file:///m{n}", "", None),
    ("file://SRV{n}/m", None): ("file://srv{n}/m", "srv{n}", None),
    ("file://K:/m{n}", None): ("file:///K:/m{n}", "", None),
    ("file://s v{n}/m", None): (None, None, "domain_invalid_code_point"),
})
def _file(text: Column, base: Column) -> tuple[Column, ...]:
    u = parse.url_parse(text, base)
    return u["href"], u["host"], u["error"]


@on_cases("url_opaque_path", "href path opaque", {
    ("x-y:a b{n}",): ("x-y:a b{n}", "a b{n}", True),
    ("x-y:a  ?q{n}",): ("x-y:a %20?q{n}", "a %20", True),
    ("x-y:a #f{n}",): ("x-y:a%20#f{n}", "a%20", True),
    ("x-y:a{n}  ",): ("x-y:a{n}", "a{n}", True),
    ("x-y:ü{n}\x7f",): ("x-y:%C3%BC{n}%7F", "%C3%BC{n}%7F", True),
    ("x-y:<\">{n}",): ("x-y:<\">{n}", "<\">{n}", True),
    ("x-y:/a b{n}",): ("x-y:/a%20b{n}", "/a%20b{n}", False),
    ("x-y:/.//p{n}",): ("x-y:/.//p{n}", "//p{n}", False),
    ("x-y:/a/..//p{n}",): ("x-y:/.//p{n}", "//p{n}", False),
    ("x-y:/..//p{n}/..",): ("x-y:/.//", "//", False),
})
def _opaque(text: Column) -> tuple[Column, ...]:
    u = parse.url_parse(text)
    return u["href"], u["path"], u["opaque_path"]


@on_cases("set_prefixed_path", "path_set host_set", {
    ("x-y:/a{n}", "//q{n}", "h{n}"): ("x-y:/.//q{n}", "x-y://h{n}/a{n}"),
    ("x-y:/.//a{n}", "/q", "h"): ("x-y:/q", "x-y://h//a{n}"),
    ("x-y://k{n}/a", "//q", "h:7"): ("x-y://k{n}//q", "x-y://h:7/a"),
    ("x-y:a{n}", "/q", "h"): ("x-y:a{n}", "x-y:a{n}"),
})
def _prefixed(text: Column, path: Column, host: Column) -> tuple[Column, ...]:
    u = parse.url_parse(text)
    return parse.set_part(u, "pathname", path)["url"]["href"], parse.set_part(u, "host", host)["url"]["href"]


@on_cases("set_accepted", "protocol username port pathname hostname", {
    ("http://h{n}:90/a", "HTTPS:x", "u", "00443", "b", "q{n}.test"): (True, True, True, True, True),
    ("http://h{n}/a", "mailto", "", "x1", "", ""): (False, True, False, True, False),
    ("file:///h{n}", "http", "u", "1", "b", "h"): (False, False, False, True, True),
    ("mailto:x{n}", "x-y", "u", "1", "b", "h"): (True, False, False, False, False),
    ("x-y://h{n}", "http", "u", "65536", "", "h<"): (False, True, False, True, False),
    ("http://u@h{n}/", "file", "v", "8x", "b", "h:1"): (False, True, True, True, False),
    ("bad {n}", "http", "u", "1", "b", "h"): (False, False, False, False, False),
})
def _accepted(text: Column, *values: Column) -> tuple[Column, ...]:
    u = parse.url_parse(text)
    return tuple(parse.set_part(u, p, v)["accepted"] for p, v in zip(_NAMES["set_accepted"], values))


_KINDS_OF_URL = {
    ("http://u:p@h{n}/",): (True, True, False, True, True, False, True, "Domain", "u", "p"),
    ("https://1.2.3.4/{n}",): (True, True, False, True, False, False, True, "IPv4", "", ""),
    ("wss://u@[::1]/{n}",): (True, True, False, False, True, False, True, "IPv6", "u", ""),
    ("file:///x{n}",): (True, True, True, False, False, False, False, "Empty", "", ""),
    ("file://srv/x{n}",): (True, True, True, False, False, False, False, "Domain", "", ""),
    ("mailto:x{n}",): (True, False, False, False, False, True, False, None, "", ""),
    ("x-y://:p@H{n}/",): (True, False, False, False, True, False, True, "Opaque", "", "p"),
    ("x-y:///{n}",): (True, False, False, False, False, False, False, "Empty", "", ""),
    ("no url {n}",): (False, False, False, False, False, False, False, None, "", ""),
}


@on_cases("url_kinds", "valid special file http credentials opaque can_have_port host_type username password", _KINDS_OF_URL)
def _kinds_of_url(text: Column) -> tuple[Column, ...]:
    u = parse.url_parse(text)
    told = (R.is_valid, R.is_special_scheme, R.is_file_scheme, R.is_http_scheme, R.has_credentials, R.has_opaque_path, R.can_have_port, R.host_type)
    return (*[f(u) for f in told], R.username(u), R.password(u))


_PARTS = ("scheme", "username", "password", "host", "port", "path", "query", "fragment")
_PLACES = {
    ("ftp://ab:c@site:77/p?qq#f",): ("0-3", "6-8", "9-10", "11-15", "16-18", "18-20", "21-23", "24-25", "0-4", "20-23", "23-25"),
    ("https://site/p?#",): ("0-5", "8-8", "8-8", "8-12", "12-12", "12-14", "15-15", "16-16", "0-6", "15-15", "16-16"),
    ("wss://u@site/",): ("0-3", "6-7", "7-7", "8-12", "12-12", "12-13", "13-13", "13-13", "0-4", "13-13", "13-13"),
    ("x-y:/.//p#ff",): ("0-3", "4-4", "4-4", "4-4", "4-4", "6-9", "9-9", "10-12", "0-4", "9-9", "9-12"),
    ("mailto:x?q",): ("0-6", "7-7", "7-7", "7-7", "7-7", "7-8", "9-10", "10-10", "0-7", "8-10", "10-10"),
}


@on_cases("url_part_places", " ".join(_PARTS) + " protocol search hash", _PLACES)
def _places(text: Column) -> tuple[Column, ...]:
    u = parse.url_parse(text)
    told = lambda p, sep=False: (lambda at: F.concat_ws("-", at["begin"].cast("string"), at["end"].cast("string")))(R.part_pos(u, p, sep))
    return (*[told(p) for p in _PARTS], *[told(p, True) for p in ("scheme", "query", "fragment")])


# Hosts and addresses


@on_cases("opaque_host", "host error", {
    ("x-y://A_b%zz{n}/",): ("A_b%zz{n}", None),
    ("x-y://ü{n}!/",): ("%C3%BC{n}!", None),
    ("x-y://a<b{n}/",): (None, "host_invalid_code_point"),
    ("x-y://a^{n}/",): (None, "host_invalid_code_point"),
    ("x-y://a {n}/",): (None, "host_invalid_code_point"),
    ("x-y://1.2.3.{n}.5/",): ("1.2.3.{n}.5", None),
    ("x-y://[::2]/{n}",): ("[::2]", None),
    ("x-y://\"{n}`/",): ("\"{n}`", None),
})
def _opaque_host(text: Column) -> tuple[Column, ...]:
    u = parse.url_parse(text)
    return u["host"], u["error"]


@on_cases("ipv6_cases", "text error", {
    ("::",): ("::", None),
    ("0:0:0:0:0:0:0:0",): ("::", None),
    ("2001:DB8::0A0b",): ("2001:db8::a0b", None),
    ("1:0:0:2:0:0:0:3",): ("1:0:0:2::3", None),
    ("1:0:0:2:3:0:0:4",): ("1::2:3:0:0:4", None),
    ("1:0:2:0:3:0:4:0",): ("1:0:2:0:3:0:4:0", None),
    ("0:0:5:6:7:8:9:a",): ("::5:6:7:8:9:a", None),
    ("5:6:7:8:9:a:0:0",): ("5:6:7:8:9:a::", None),
    ("::ffff:192.168.7.9",): ("::ffff:c0a8:709", None),
    ("6:5:4:3:2:1:10.0.0.1",): ("6:5:4:3:2:1:a00:1", None),
    ("1:2:3:4:5:6:7::",): ("1:2:3:4:5:6:7:0", None),
    (":2:3",): (None, "ipv6_invalid_compression"),
    ("2:3",): (None, "ipv6_too_few_pieces"),
    ("9:8:7:6:5:4:3:2:1",): (None, "ipv6_too_many_pieces"),
    ("a::b::c",): (None, "ipv6_multiple_compression"),
    ("a::g",): (None, "ipv6_invalid_code_point"),
    ("a:b:c:d:e:f:0:10.0.0.1",): (None, "ipv4_in_ipv6_too_many_pieces"),
    ("::10.0.0.256",): (None, "ipv4_in_ipv6_out_of_range_part"),
    ("::10.0.01.1",): (None, "ipv4_in_ipv6_invalid_code_point"),
    ("::10.0.1",): (None, "ipv4_in_ipv6_too_few_parts"),
})
def _ipv6(text: Column) -> tuple[Column, ...]:
    got = parse.ipv6_canonical(text)
    return got["text"], got["error"]


@on_cases("url_host_cases", "host host_type error", {
    ("Shop{n}.TEST",): ("shop{n}.test", "Domain", None),
    ("0x7F.0.0.1",): ("127.0.0.1", "IPv4", None),
    ("3232235777",): ("192.168.1.1", "IPv4", None),
    ("010.1.1.1.",): ("8.1.1.1", "IPv4", None),
    ("a{n}.1.2",): (None, None, "ipv4_non_numeric_part"),
    ("1.1.1.300",): (None, None, "ipv4_out_of_range_part"),
    ("%41{n}.test",): ("a{n}.test", "Domain", None),
    ("a%2f{n}",): (None, None, "domain_invalid_code_point"),
    ("[1::1]",): ("[1::1]", "IPv6", None),
    ("[1::1",): (None, None, "ipv6_unclosed"),
    ("",): (None, None, "host_missing"),
    ("xn--{n}é",): (None, None, "domain_to_ascii"),
})
def _hosts(text: Column) -> tuple[Column, ...]:
    h = parse.url_host(text)
    return h["host"], h["host_type"], h["error"]


_DOMAINS = {
    ("Faß.example",): ("xn--fa-hia.example", "faß.example", True),
    ("BÜCHER.example",): ("xn--bcher-kva.example", "bücher.example", True),
    ("испытание",): ("xn--80akhbyknj4f", "испытание", True),
    ("测试。測試",): ("xn--0zwm56d.xn--g6w251d", "测试.測試", True),
    ("δοκιμή",): ("xn--jxalpdlp", "δοκιμή", True),
    ("परीक्षा",): ("xn--11b5bs3a9aj6g", "परीक्षा", True),
    ("테스트",): ("xn--9t4b11yi5a", "테스트", True),
    ("טעסט",): ("xn--deba0ad", "טעסט", True),
    ("ＡＢＣ.Ⅷ",): ("abc.viii", "abc.viii", True),
    ("so\u00adft",): ("soft", "soft", True),
    ("a\u0308.example",): ("xn--4ca.example", "ä.example", True),
    ("xn--bcher-kva",): ("xn--bcher-kva", "bücher", True),
    ("xn--bcher-KVA.x{n}",): ("xn--bcher-kva.x{n}", "bücher.x{n}", True),
    ("xn--ls8h=",): (None, "xn--ls8h=", False),
    ("xn--",): (None, "xn--", False),
    ("\u0308a{n}",): (None, "\u0308a{n}", False),
    ("אa",): (None, "אa", False),
    ("x\u200cy{n}",): (None, "x\u200cy{n}", False),
    ("\u2028",): (None, "\u2028", False),
    ("a_{n}.-b",): ("a_{n}.-b", "a_{n}.-b", True),
}


@on_cases("idna_cases", "ascii text ok", _DOMAINS)
def _domains(text: Column) -> tuple[Column, ...]:
    u = parse.domain_to_unicode(text)
    return parse.domain_to_ascii(text), u["value"], u["ok"]


@on_cases("idna_options", "strict hyphens std3 lengths", {
    ("-a{n}",): (None, None, "-a{n}", "-a{n}"),
    ("ab--c{n}",): (None, None, "ab--c{n}", "ab--c{n}"),
    ("a_b{n}",): (None, "a_b{n}", None, "a_b{n}"),
    ("a{n}..b",): (None, "a{n}..b", "a{n}..b", None),
    ("a{n}.b.",): ("a{n}.b.", "a{n}.b.", "a{n}.b.", "a{n}.b."),
    ("l" * 64,): (None, "l" * 64, "l" * 64, None),
    ("ok{n}.test",): ("ok{n}.test", "ok{n}.test", "ok{n}.test", "ok{n}.test"),
})
def _idna_options(text: Column) -> tuple[Column, ...]:
    one = lambda **k: parse.domain_to_ascii(text, **k)
    return one(strict=True), one(check_hyphens=True), one(std3=True), one(dns_length=True)


@on_cases(
    "idna_faults",
    "faults",
    {
    ("ok{n}",): ("",), ("xn--",): ("invalid_ace_label",), ("xn--a!",): ("punycode",), ("\u0308a",): ("leading_mark",), ("x\u200cy{n}",): ("context_joiner",),
    ("אa",): ("bidi",), ("\u2028{n}",): ("disallowed",), ("\u0308\u200d",): ("context_joiner,leading_mark",),
},
)
def _idna_faults(text: Column) -> tuple[Column, ...]:
    return (F.array_join(parse.domain_to_unicode(text)["faults"], ","),)


# Encoding


@on_cases("decode_cases", "percent form", {
    ("%41%zz%C3%BC{n}+",): ("A%zzü{n}+", "A%zzü{n} "),
    ("100%",): ("100%", "100%"),
    ("%2",): ("%2", "%2"),
    ("%25%32%35{n}",): ("%25{n}", "%25{n}"),
    ("%E6%BC%A2+%2B",): ("漢++", "漢 +"),
    ("a%FFb{n}",): ("a\ufffdb{n}", "a\ufffdb{n}"),
    ("plain {n}",): ("plain {n}", "plain {n}"),
})
def _decode(text: Column) -> tuple[Column, ...]:
    return E.percent_decode(text), E.form_decode(text)


@on_cases(
    "utf_cases",
    "from_8 from_16le from_16be",
    {
    ("6100", "6100", "0061"): ("a\x00", "a", "a"), ("C3BC", "FC00", "00FC"): ("ü", "ü", "ü"), ("E6BCA2", "226F", "6F22"): ("漢", "漢", "漢"),
    ("F09F9880", "3DD800DE", "D83DDE00"): ("😀", "😀", "😀"), ("61FF62", "61006200", "00610062"): ("a\ufffdb", "ab", "ab"), ("E6BC", "", ""): ("\ufffd", "", ""),
},
)
def _utf(eight: Column, low: Column, high: Column) -> tuple[Column, ...]:
    return E.utf8_text(F.unhex(eight)), E.utf8_text(F.unhex(low), "UTF-16LE"), E.utf8_text(F.unhex(high), "UTF-16BE")


# Parameters


@on_cases("params_parse_cases", "q first n cleared", {
    ("http://h/?", "?a=1&a={n}&b"): ("a=1&a={n}&b=", "1", 3, "http://h/"),
    ("http://h/?x=1#f", "??a=%zz+{n}"): ("%3Fa=%25zz+{n}", None, 1, "http://h/#f"),
    ("http://h/p?x={n}", "&&=&a=b=c"): ("=&a=b%3Dc", "b=c", 2, "http://h/p"),
    ("http://h/", ""): ("", None, 0, "http://h/"),
})
def _params(text: Column, query: Column) -> tuple[Column, ...]:
    own = P.parse(query, strip_mark=True)
    return P.to_string(own), P.get(own, "a"), P.size(own), R.with_params(parse.url_parse(text), P.empty())["href"]


@on_cases(
    "params_sort_cases",
    "q",
    {
    ("z={n}&ﬀ=1&🌈=2&a=3&z=0",): ("a=3&z={n}&z=0&%F0%9F%8C%88=2&%EF%AC%80=1",), ("b=2&B=1&a=&aa=0",): ("B=1&a=&aa=0&b=2",), ("é=1&e={n}&=0",): ("=0&e={n}&%C3%A9=1",),
},
)
def _sorted(query: Column) -> tuple[Column, ...]:
    return (P.to_string(P.sort(P.parse(query))),)


# Patterns

_WITH_BASE = compile_pattern("/shop/:id(\\d+)", "https://site.test")
_SCHEMES = compile_pattern({"protocol": "http{s}?", "hostname": "site.test", "port": "443"})
_SIX = compile_pattern({"hostname": "[\\:\\:AB]", "pathname": "/:ñame_1$/*"})


@on_cases("pattern_cases", "based id schemes six name", {
    ("../shop/{n}", "https://site.test/x/y"): (True, "{n}", False, False, None),
    ("/shop/x{n}", "https://site.test/"): (False, None, False, False, None),
    ("/shop/{n}", "http://site.test/"): (False, None, False, False, None),
    ("http://site.test:443/{n}", None): (False, None, True, False, None),
    ("https://site.test:443/{n}", None): (False, None, False, False, None),
    ("http://[::ab]/v{n}/w", None): (False, None, False, True, "v{n}"),
    ("http://[::ac]/v{n}/w", None): (False, None, False, False, None),
    ("relative {n}", None): (False, None, False, False, None),
})
def _patterns(link: Column, base: Column) -> tuple[Column, ...]:
    u = parse.url_parse(link, base)
    based, six = match.execute(_WITH_BASE, u), match.execute(_SIX, u)
    return match.test(_WITH_BASE, u), based["pathname"]["groups"]["id"], match.test(_SCHEMES, u), match.test(_SIX, u), six["pathname"]["groups"]["ñame_1$"]


@on_cases("pattern_init_rows", "scheme host port path query fragment username", {
    ("https", "SHOP{n}.test", "443", "/a b", "?q=ü", "#x y", "a@b"): ("https", "shop{n}.test", "", "/a%20b", "q=%C3%BC", "x%20y", "a%40b"),
    ("http", "h", "443", "/x/../y{n}", "q", "f", ""): ("http", "h", "443", "/y{n}", "q", "f", ""),
    ("data", "", "", "a b{n}", "", "", ""): ("data", "", "", "a b{n}", "", "", ""),
    ("http", "h", "x", "/", "", "", "{n}"): (None, None, None, None, None, None, None),
})
def _init(*values: Column) -> tuple[Column, ...]:
    names = ("protocol", "hostname", "port", "pathname", "search", "hash", "username")
    got = match.init_inputs(F.struct(*[v.alias(n) for n, v in zip(names, values)]))
    return tuple(got[n] for n in _NAMES["pattern_init_rows"])


# Public suffixes


def _rules(spark: SparkSession) -> DataFrame:
    from urlmill.plans import catalog

    return suffixes.rules(suffixes.lines_of(spark, catalog.RULE_TEXT))


_SUFFIXES = {
    "a{n}.b.hosted.app": ("b.hosted.app", "a{n}.b.hosted.app", "private", True),
    "b{n}.hosted.app": ("b{n}.hosted.app", None, "private", True),
    "hosted.app": ("app", "hosted.app", "none", False),
    "www.ck": ("ck", "www.ck", "icann", False),
    "x{n}.www.ck": ("ck", "www.ck", "icann", False),
    "x{n}.shop.ck": ("shop.ck", "x{n}.shop.ck", "icann", True),
    "shop{n}.ck": ("shop{n}.ck", None, "icann", True),
    "y.x{n}.co.uk": ("co.uk", "x{n}.co.uk", "icann", False),
    "co.uk": ("co.uk", None, "icann", False),
    "x{n}.zz": ("zz", "x{n}.zz", "none", False),
    "x{n}.example.org": ("example.org", "x{n}.example.org", "private", False),
}


def _psl(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = list(_SUFFIXES)
    picked = F.get(F.array(*map(F.lit, hosts)), (F.col("page_id") % len(hosts)).cast("int"))
    own = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.replace(picked, F.lit("{n}"), F.col("page_id").cast("string")).alias("host"))
    info = F.col("suffix_info")
    section = F.when(info["is_icann"], "icann").when(info["is_private"], "private").otherwise("none")
    found = suffixes.lookup(own, "host", _rules(spark))
    return found.select("page_id", suffixes.suffix_of(F.col("host"), info).alias("suffix"), suffixes.registrable_domain(F.col("host"), info).alias("registrable_domain"), section.alias("section"), info["wildcard_rule"].alias("wildcard"))


_NAMES["psl_cases"] = ("suffix", "registrable_domain", "section", "wildcard")
_Q["psl_cases"] = _psl
_SQL["psl_cases"] = _answers_sql(list(_SUFFIXES.values()), _NAMES["psl_cases"])

_RULE_FILES = {"whole": "com\n*.ck\n", "open": "// ===BEGIN ICANN DOMAINS===\ncom", "closed": "// ===BEGIN ICANN DOMAINS===\ncom\n// ===END ICANN DOMAINS===", "bad": "com\na b"}


def _rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load status of several rule files, and whether their tables equal the first one's."""
    lines = {k: suffixes.lines_of(spark, v) for k, v in _RULE_FILES.items()}
    first = suffixes.rules(suffixes.lines_of(spark, "*.ck\n// note\ncom"))
    rows = [(k, suffixes.load_status(x).first().ok, suffixes.same_rules(first, suffixes.rules(x))) for k, x in lines.items()]
    return spark.createDataFrame(rows, "file string, ok boolean, same boolean")


_Q["psl_rule_files"] = _rule_files
_SQL["psl_rule_files"] = "SELECT * FROM (VALUES ('whole', true, true), ('open', false, false), ('closed', true, false), ('bad', false, false)) t(file, ok, same)"

# File paths


@on_cases("file_path_cases", "posix windows", {
    ("/data/{n} a#b?c%", "D:\\a{n}\\b c"): ("file:///data/{n}%20a%23b%3Fc%25", "file:///D:/a{n}/b%20c"),
    ("data/{n}", "D:a{n}"): ("file_unsupported_path", "file_unsupported_path"),
    ("/data/../{n}", "D:/a/../{n}"): ("file_unsupported_path", "file_unsupported_path"),
    ("", ""): ("file_empty_path", "file_empty_path"),
    ("/D:/{n}", "\\\\srv{n}\\share\\f"): ("file:///D%3A/{n}", "file://srv{n}/share/f"),
    ("/a\\b{n}", "\\\\?\\UNC\\srv{n}\\share"): ("file:///a%5Cb{n}", "file://srv{n}/share"),
    ("/./{n}", "\\\\?\\D:\\{n}"): ("file:///{n}", "file:///D:/{n}"),
    ("/ü{n}", "\\\\srv\\.."): ("file:///%C3%BC{n}", "file_unsupported_path"),
    ("/a..b/{n}..", "\\a{n}"): ("file:///a..b/{n}..", "file_unsupported_path"),
})
def _file_paths(posix: Column, windows: Column) -> tuple[Column, ...]:
    told = lambda u: F.coalesce(u["href"], u["error"])
    return told(filepath.url_from_file_path(posix, "posix")), told(filepath.url_from_file_path(windows, "windows"))


@on_cases("file_url_cases", "posix windows", {
    ("file:///data/{n}%20a", ): ("/data/{n} a", "file_url_not_windows_path"),
    ("file:///D:/a{n}/b", ): ("/D:/a{n}/b", "D:\\a{n}\\b"),
    ("file:///D:", ): ("/D:", "D:\\"),
    ("file://srv{n}/share/f", ): ("file_url_cannot_have_host", "\\\\srv{n}\\share\\f"),
    ("file:///a%00{n}", ): ("null_character", "file_url_not_windows_path"),
    ("file:///%C3%BC+%zz{n}", ): ("/ü+%zz{n}", "file_url_not_windows_path"),
    ("http://h/{n}", ): ("not_file_url", "not_file_url"),
})
def _file_urls(text: Column) -> tuple[Column, ...]:
    u = parse.url_parse(text)
    told = lambda form: (lambda r: F.coalesce(r["path"], r["error"]))(filepath.path_from_file_url(u, form))
    return told("posix"), told("windows")


# Sources, sinks, streams, compositions


def _register(name: str, sql: str) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _Q[name], _SQL[name] = f, sql
        return f

    return keep


@_register("sample_files", """
    WITH s AS (SELECT page_id, unnest([1, 2, 3]) AS k FROM pages)
    SELECT page_id, CASE k WHEN 1 THEN concat('/d/x', page_id) WHEN 2 THEN '?ü' ELSE 'no base' END AS input,
           CASE k WHEN 1 THEN concat('http://s', page_id, '.test/d/x', page_id) WHEN 2 THEN concat('http://s', page_id, '.test/a?%C3%BC') END AS href,
           CASE WHEN k < 3 THEN concat('http://s', page_id, '.test') END AS origin, k = 3 AS failure FROM s""")  # fmt: skip
def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a sample file per page, read as samples and written as JSON objects."""
    n = F.col("page_id").cast("string")
    own = F.array(
        F.lit("COMMENT: a sample"), F.concat(F.lit("BASE: http://s"), n, F.lit(".test/a")), F.concat(F.lit("URL: /d/x"), n),
        F.lit('URL: "?\\u00fc"'), F.lit("BASE:"), F.lit("URL: no base"),
    )
    lines = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("path"), F.posexplode(own).alias("line_no", "line"))
    text = links.as_json(links.samples(lines), keep=["path"])
    at = lambda k: F.get_json_object("value", f"$.{k}")
    failure = F.coalesce(at("failure") == "true", F.lit(False))
    return text.select(F.col("path").alias("page_id"), at("input").alias("input"), at("href").alias("href"), at("origin").alias("origin"), failure.alias("failure"))


@_register("domain_counts", """
    SELECT (page_id // 5) * 300 AS window_start, CASE page_id % 3 WHEN 0 THEN 'a.com' WHEN 1 THEN 'b.co.uk' END AS registrable_domain, count(*) AS n
    FROM pages GROUP BY ALL""")  # fmt: skip
def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's windowed counts, here over a table: a page a minute."""
    url = F.get(F.array(F.lit("http://x.A.com/?utm_x=1"), F.lit("http://B.co.uk"), F.lit("http://10.0.0.1/")), (F.col("page_id") % 3).cast("int"))
    own = spark.read.parquet(f"{sf_dir}/pages.parquet").select(url.alias("url"), F.timestamp_seconds(F.col("page_id") * 60).alias("at"))
    counted = streams.domain_counts(streams.canonical(own, "url", _rules(spark)), "at")
    return counted.select(F.col("window.start").cast("long").alias("window_start"), "registrable_domain", "n")


@_register(
    "nfc",
    "SELECT doc_id, nfc_normalize(concat(substr(text, 1, 40), 'e', chr(769), chr(4370), chr(4449), chr(4523))) AS composed FROM documents",
)
def _nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat(F.substr("text", F.lit(1), F.lit(40)), F.lit("e\u0301\u1112\u1161\u11ab"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", parse.nfc(own).alias("composed"))


@_register("url_hash_distinct", "SELECT count(DISTINCT url) AS hashes, count(*) AS rows FROM pages")
def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = parse.parse_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), "url", "u")
    return own.agg(F.count_distinct(R.url_hash(F.col("u"))).alias("hashes"), F.count("*").alias("rows"))


@_register("url_strict", "SELECT page_id, concat('http://h', page_id, '.test/', page_id) AS href FROM pages")
def _strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    text = F.concat(F.lit("HTTP:\\\\h"), n, F.lit(".TEST:80/x/../"), n)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", parse.strict_parse(text)["href"].alias("href"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
