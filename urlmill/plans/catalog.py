"""Registered queries of the URL engine and their SQL.

The pages' own URLs are plain, so many queries run on ``hard`` texts made from them: upper-case scheme and
host, user information, a port, dot segments, characters to escape, a fragment. Both engines build them by
the same concatenation; the SQL states the expected components without parsing the hard text.
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
from urlmill.plans import cases

#: A small rule table for the pages' hosts; any rule file of the public format is read by ``suffixes.read_lines``.
RULE_TEXT = """// ===BEGIN ICANN DOMAINS===
com
net
org
uk
co.uk
*.ck
!www.ck
// ===END ICANN DOMAINS===
// ===BEGIN PRIVATE DOMAINS===
example.org
*.hosted.app
// ===END PRIVATE DOMAINS==="""
ROUTES = {
    "english": "http{s}?://*/en/:id",
    "german": "http{s}?://*/de/:id",
    "blog": "http{s}?://blog.*/*",
    "dot_html": "http{s}?://*/:lang/:name(\\d+).html",
}

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: SQL of the pages' components.
U = r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
  CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END AS path,
  CASE WHEN url LIKE '%?%' THEN regexp_extract(url, '\?([^#]*)', 1) END AS query, CASE WHEN url LIKE '%#%' THEN regexp_extract(url, '#(.*)$', 1) END AS fragment FROM pages),
 p AS (SELECT *, list_transform(list_filter(string_split(coalesce(query, ''), '&'), lambda x: x <> ''), lambda x: {'name': split_part(x, '=', 1), 'value': split_part(x, '=', 2)}) AS params FROM u)
"""


def _pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", *columns)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_urls(_pages(spark, sf_dir), "url", "u")


def _hard_text() -> Column:
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    return F.concat(F.lit(" HTTP://Us er:P@ss@"), F.upper(host), F.lit(":"), (8000 + F.col("page_id") % 100).cast("string"), F.lit("/a/./b/../%2e%2E/c d/\\e?q='"), F.col("page_id").cast("string"), F.lit("'&x=<ü>#F \""))


def _hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", "url", parse.url_parse(_hard_text()).alias("u"))


def add(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        _Q[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def on_pages(name: str, columns: Callable[[Column], dict[str, Column]], sql: str, source=_records) -> None:
    """A projection of page_id and ``columns`` of the record."""
    add(name, sql)(lambda spark, d: source(spark, d).select("page_id", *[c.alias(n) for n, c in columns(F.col("u")).items()]))


# Encoding



def _on_text(name: str, expression: Callable[[Column], Column], sql: str) -> None:
    add(name, f"SELECT doc_id, {sql} AS coded FROM documents")(lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", expression(F.col("text")).alias("coded")))


def _sql_encode(kept: frozenset[str]) -> str:
    """DuckDB's url_encode keeps letters, digits and ``-_.~``; the set's other characters are put back."""
    out = "url_encode(text)"
    for c in sorted(kept - set("-_.~%") - set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")):
        quoted = "''" if c == "'" else c
        out = f"replace({out}, '%{ord(c):02X}', '{quoted}')"
    return f"replace({out}, '%25', '%')" if "%" in kept else out


_on_text("percent_encode_path", lambda t: E.percent_encode(t, "path"), _sql_encode(E.kept("path")))
_on_text("percent_encode_query", lambda t: E.percent_encode(t, "query"), _sql_encode(E.kept("query")))
_on_text("percent_encode_fragment", lambda t: E.percent_encode(t, "fragment"), _sql_encode(E.kept("fragment")))
_on_text("percent_encode_userinfo", lambda t: E.percent_encode(t, "userinfo"), _sql_encode(E.kept("userinfo")))
_on_text("percent_encode_component", E.encode_url_component, _sql_encode(E.kept("component")))
_on_text("percent_decode", lambda t: E.percent_decode(E.encode_url_component(t)), "text")
_on_text("form_urlencode", E.form_encode, "replace(replace(replace(url_encode(text), '%20', '+'), '~', '%7E'), '%2A', '*')")
_on_text("form_urldecode", lambda t: E.form_decode(E.form_encode(t)), "text")
_on_text("utf8_fix", E.fix_utf8, "text")

# Components, getters and predicates

on_pages("url_components", lambda u: {n: u[n] for n in ("scheme", "username", "password", "host", "port", "path", "query", "fragment")},
         U + "SELECT page_id, scheme, '' AS username, '' AS password, host, NULL::INTEGER AS port, path, query, fragment FROM u")
on_pages(
    "url_components_hard",
    lambda u: {n: u[n] for n in ("href", "scheme", "username", "password", "host", "port", "path", "query", "fragment")},
    U + """, h AS (SELECT page_id, host, (8000 + page_id % 100)::INTEGER AS port, '/c%20d//e' AS path, concat('q=%27', page_id, '%27&x=%3C%C3%BC%3E') AS query, 'F%20%22' AS fragment FROM u)
         SELECT page_id, concat('http://Us%20er:P%40ss@', host, ':', port, path, '?', query, '#', fragment) AS href, 'http' AS scheme, 'Us%20er' AS username, 'P%40ss' AS password, host, port, path, query, fragment FROM h""",
    source=_hard,
)
on_pages(
    "url_href",
    lambda u: {"href": R.href(u)},
    U
    + "SELECT page_id, concat(scheme, '://', host, path, CASE WHEN query IS NULL THEN '' ELSE '?' || query END, CASE WHEN fragment IS NULL THEN '' "
      "ELSE '#' || fragment END) AS href FROM u",
)
add("url_origin", U + "SELECT page_id, concat(scheme, '://', host) AS origin FROM u")(
    lambda s, d: parse.origins(_records(s, d), "u").select("page_id", "origin"),
)
on_pages("url_protocol", lambda u: {"protocol": R.protocol(u)}, U + "SELECT page_id, scheme || ':' AS protocol FROM u")
on_pages(
    "url_credentials",
    lambda u: {"username": R.username(u), "password": R.password(u)},
    U + "SELECT page_id, 'Us%20er' AS username, 'P%40ss' AS password FROM u",
    source=_hard,
)
on_pages(
    "url_host_port",
    lambda u: {"host_port": R.host(u), "hostname": R.hostname(u), "port_text": R.port(u), "port_int": R.port_int(u)},
    U
    + "SELECT page_id, concat(host, ':', 8000 + page_id % 100) AS host_port, host AS hostname, (8000 + page_id % 100)::VARCHAR AS port_text, (8000 + "
      "page_id % 100)::INTEGER AS port_int FROM u",
    source=_hard,
)
on_pages(
    "url_real_port",
    lambda u: {"port_int": R.port_int(u), "real_port": R.real_port_int(u)},
    U + "SELECT page_id, -1 AS port_int, (CASE scheme WHEN 'https' THEN 443 ELSE 80 END)::INTEGER AS real_port FROM u",
)
on_pages(
    "url_path_search",
    lambda u: {"path_search": R.path(u), "pathname": R.pathname(u)},
    U + "SELECT page_id, path || CASE WHEN query IS NULL THEN '' ELSE '?' || query END AS path_search, path AS pathname FROM u",
)
on_pages(
    "url_search",
    lambda u: {"search": R.search(u)},
    U + "SELECT page_id, CASE WHEN coalesce(query, '') = '' THEN '' ELSE '?' || query END AS search FROM u",
)
on_pages(
    "url_hash",
    lambda u: {"hash": R.hash(u)},
    U + "SELECT page_id, CASE WHEN coalesce(fragment, '') = '' THEN '' ELSE '#' || fragment END AS hash FROM u",
)
on_pages(
    "url_serialize_nofrag",
    lambda u: {"href": R.serialize(u, True)},
    "SELECT page_id, CASE WHEN url LIKE '%#%' THEN substr(url, 1, instr(url, '#') - 1) ELSE url END AS href FROM pages",
)
on_pages(
    "url_part_view",
    lambda u: {"query": R.part(u, "query"), "query_null": R.is_null(u, "query"), "fragment_empty": R.is_empty(u, "fragment")},
    U + "SELECT page_id, coalesce(query, '') AS query, query IS NULL AS query_null, coalesce(fragment, '') = '' AS fragment_empty FROM u",
)
on_pages(
    "url_predicates",
    lambda u: {"valid": R.is_valid(u), "empty": R.empty(u), "special": R.is_special_scheme(u), "file": R.is_file_scheme(u), "http": R.is_http_scheme(u), "credentials": R.has_credentials(u), "opaque": R.has_opaque_path(u), "can_have_port": R.can_have_port(u)},
    "SELECT page_id, true AS valid, false AS empty, true AS special, false AS file, true AS http, false AS credentials, false AS opaque, true AS "
    "can_have_port FROM pages",
)
on_pages(
    "url_part_pos",
    lambda u: {f"{p}_{e}": R.part_pos(u, p)[e] for p in ("host", "path", "query", "fragment") for e in ("begin", "end")},
    U + """, l AS (SELECT page_id, (length(scheme) + 3)::INTEGER AS hb, length(host)::INTEGER AS hl, length(path)::INTEGER AS pl, coalesce(length(query), 0)::INTEGER AS ql, (query IS NOT NULL)::INTEGER AS q1, coalesce(length(fragment), 0)::INTEGER AS fl, (fragment IS NOT NULL)::INTEGER AS f1 FROM u)
         SELECT page_id, hb AS host_begin, hb + hl AS host_end, hb + hl AS path_begin, hb + hl + pl AS path_end, hb + hl + pl + q1 AS query_begin, hb + hl + pl + q1 + ql AS query_end, hb + hl + pl + q1 + ql + f1 AS fragment_begin, hb + hl + pl + q1 + ql + f1 + fl AS fragment_end FROM l""",
)
on_pages("url_host_type", lambda u: {"host_type": R.host_type(u)}, "SELECT page_id, 'Domain' AS host_type FROM pages")
add("url_can_parse", "SELECT page_id, page_id % 3 <> 0 AS ok FROM pages")(
    lambda s, d: _pages(s, d).select("page_id", parse.can_parse(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("http://a b/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))).alias("ok")),
)
_BAD = {"http://1.2.3.4.5/": "ipv4_too_many_parts", "http://a:99999/": "port_out_of_range", "http://a:8x/": "port_invalid", "http://[::1": "ipv6_unclosed", "https://#f": "host_missing", "rel": "missing_scheme_non_relative_url", "foo://a[b": "host_invalid_code_point", "http://h[]/p": "domain_invalid_code_point", "http://xn--a/": "domain_to_ascii"}
add("url_parse_error", "SELECT page_id, [" + ", ".join(f"'{v}'" for v in _BAD.values()) + f"][1 + page_id % {len(_BAD)}] AS error FROM pages")(
    lambda s, d: _pages(s, d).select("page_id", parse.url_parse(F.element_at(F.array(*[F.lit(k) for k in _BAD]), (F.col("page_id") % len(_BAD)).cast("int") + 1))["error"].alias("error")),
)
_LINKS = r"""WITH l AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1))) AS link FROM pages)
SELECT page_id, link, CASE WHEN link LIKE 'http%' THEN link ELSE regexp_extract(url, '^[a-z]+://[^/?#]+') || replace(replace(replace(replace(url_encode(link), '%2F', '/'), '%2C', ','), '%3A', ':'), '%3B', ';') END AS href FROM l WHERE regexp_matches(link, '^/[^?#&]*$')"""


@add("resolve_links", _LINKS)
def _resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _pages(spark, sf_dir, "html").select("page_id", "url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), F.lit(1)))).alias("link"))
    return parse.resolve_links(links, "link", "url", "u").select("page_id", "link", F.col("u.href").alias("href"))


# Setters on the hard texts

_SETS: dict[str, tuple[Column | str, str, str]] = {
    "protocol": ("https", "href", "concat('https://Us%20er:P%40ss@', host, ':', port, rest)"),
    "username": ("n@w", "href", "concat('http://n%40w:P%40ss@', host, ':', port, rest)"),
    "password": ("", "href", "concat('http://Us%20er@', host, ':', port, rest)"),
    "host": ("EXAMPLE.org:81", "href", "concat('http://Us%20er:P%40ss@example.org:81', rest)"),
    "hostname": ("0x7f.1", "href", "concat('http://Us%20er:P%40ss@127.0.0.1:', port, rest)"),
    "port": ("80x", "href", "concat('http://Us%20er:P%40ss@', host, rest)"),
    "pathname": ("x/../y?z", "href", "concat('http://Us%20er:P%40ss@', host, ':', port, '/y%3Fz', tail)"),
    "search": ("?a b", "href", "concat('http://Us%20er:P%40ss@', host, ':', port, '/c%20d//e?a%20b#F%20%22')"),
    "hash": ("", "href", "concat('http://Us%20er:P%40ss@', host, ':', port, '/c%20d//e', split_part(tail, '#', 1))"),
    "href": ("ws://h:80", "href", "'ws://h/'"),
}
for _part, (_value, _, _expected) in _SETS.items():
    add(f"set_{_part}", U + f""", h AS (SELECT page_id, host, (8000 + page_id % 100)::INTEGER AS port, concat('?q=%27', page_id, '%27&x=%3C%C3%BC%3E#F%20%22') AS tail FROM u), r AS (SELECT *, '/c%20d//e' || tail AS rest FROM h)
        SELECT page_id, {_expected} AS href, true AS accepted FROM r""")(
        lambda s, d, part=_part, value=_value: _hard(s, d).withColumn("r", parse.set_part(F.col("u"), part, F.lit(value))).select("page_id", F.col("r.url.href").alias("href"), F.col("r.accepted").alias("accepted")))
add("set_rejected", "SELECT page_id, false AS protocol, false AS port, false AS hostname FROM pages")(
    lambda s, d: _hard(s, d).select("page_id", *[parse.set_part(F.col("u"), p, F.lit(v))["accepted"].alias(p) for p, v in (("protocol", "mailto"), ("port", "x"), ("hostname", ""))]),
)

# Equality


@add("url_equals", "SELECT page_id, true AS same, (url NOT LIKE '%#%') AS same_with_fragment FROM pages")
def _equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = parse.parse_urls(_records(spark, sf_dir).withColumn("bare", F.regexp_replace(F.upper(F.substring("url", 1, 5)), "$", "")).withColumn("other", F.concat("bare", F.regexp_replace(F.expr("substr(url, 6)"), "#.*$", ""))), "other", "v")
    return both.select("page_id", R.equals(F.col("u"), F.col("v"), True).alias("same"), R.equals(F.col("u"), F.col("v")).alias("same_with_fragment"))


add("url_dedupe", "SELECT url AS href, count(*) AS n FROM pages GROUP BY url")(
    lambda s, d: _records(s, d).groupBy(F.col("u.href").alias("href")).agg(F.count("*").alias("n")),
)

# Parameters

_params = lambda u: R.search_params(u)
_LIT = "array_to_string(list_transform({}, lambda x: x.name || '=' || x.value), '&')"
add(
    "params_explode",
    U
    + ", e AS (SELECT page_id, unnest(params) AS x, unnest(range(len(params)))::INTEGER AS pos FROM p) SELECT page_id, pos, x.name AS name, x.value "
      "AS value FROM e",
)(
    lambda s, d: _records(s, d).select("page_id", F.posexplode(_params(F.col("u"))).alias("pos", "x")).select("page_id", "pos", F.col("x.name").alias("name"), F.col("x.value").alias("value")),
)
on_pages(
    "params_get",
    lambda u: {"ref": P.get(_params(u), "ref")},
    U + "SELECT page_id, list_filter(params, lambda x: x.name = 'ref')[1].value AS ref FROM p",
)
on_pages(
    "params_get_all",
    lambda u: {"page_values": F.array_join(P.get_all(P.append(_params(u), "page", "9"), "page"), ",")},
    U
    + "SELECT page_id, array_to_string(list_append(list_transform(list_filter(params, lambda x: x.name = 'page'), lambda x: x.value), '9'), ',') AS "
      "page_values FROM p",
)
on_pages(
    "params_has",
    lambda u: {"has_ref": P.has(_params(u), "ref"), "has_ref_y": P.has(_params(u), "ref", "y")},
    U + "SELECT page_id, len(list_filter(params, lambda x: x.name = 'ref')) > 0 AS has_ref, false AS has_ref_y FROM p",
)
on_pages(
    "params_append",
    lambda u: {"q": P.to_string(P.append(_params(u), "a b", "ü"))},
    U + f"SELECT page_id, concat_ws('&', nullif({_LIT.format('params')}, ''), 'a+b=%C3%BC') AS q FROM p",
)
on_pages(
    "params_set",
    lambda u: {"q": P.to_string(P.put(_params(u), "page", "1"))},
    U
    + f"SELECT page_id, CASE WHEN len(list_filter(params, lambda x: x.name = 'page')) > 0 THEN array_to_string(list_transform(params, lambda x: "
      f"x.name || '=' || CASE WHEN x.name = 'page' THEN '1' ELSE x.value END), '&') ELSE concat_ws('&', nullif({_LIT.format('params')}, ''), "
      f"'page=1') END AS q FROM p",
)
on_pages(
    "params_delete",
    lambda u: {"href": R.with_params(u, P.delete(_params(u), "ref"))["href"]},
    U
    + f", k AS (SELECT *, {_LIT.format('list_filter(params, lambda x: x.name <> ' + chr(39) + 'ref' + chr(39) + ')')} AS q FROM p) SELECT page_id, "
      f"concat(scheme, '://', host, path, CASE WHEN q = '' THEN '' ELSE '?' || q END, CASE WHEN fragment IS NULL THEN '' ELSE '#' || fragment END) AS "
      f"href FROM k",
)
on_pages(
    "params_remove_count",
    lambda u: {"gone": P.removed(_params(u), P.remove(_params(u), "page"))},
    U + "SELECT page_id, len(list_filter(params, lambda x: x.name = 'page'))::INTEGER AS gone FROM p",
)
on_pages(
    "params_remove_utm",
    lambda u: {"href": R.with_params(u, P.remove_if(_params(u), lambda x: x["name"].startswith("utm_")))["href"]},
    U
    + f", k AS (SELECT *, {_LIT.format('list_filter(params, lambda x: NOT starts_with(x.name, ' + chr(39) + 'utm_' + chr(39) + '))')} AS q FROM p) "
      f"SELECT page_id, concat(scheme, '://', host, path, CASE WHEN q = '' THEN '' ELSE '?' || q END, CASE WHEN fragment IS NULL THEN '' ELSE '#' || "
      f"fragment END) AS href FROM k",
)
on_pages(
    "params_sort",
    lambda u: {"q": P.to_string(P.sort(P.append(_params(u), "m", "1")))},
    U
    + ", k AS (SELECT page_id, list_sort(list_transform(list_append(params, {'name': 'm', 'value': '1'}), lambda x: x.name || '=' || x.value)) AS s "
      "FROM p) SELECT page_id, array_to_string(s, '&') AS q FROM k",
)
on_pages("params_to_string", lambda u: {"q": P.to_string(_params(u))}, U + f"SELECT page_id, {_LIT.format('params')} AS q FROM p")
on_pages("params_size", lambda u: {"n": P.size(_params(u))}, U + "SELECT page_id, len(params)::INTEGER AS n FROM p")

# Addresses

_IP = "concat('0x', lower(hex(page_id % 256)), '.', page_id % 65536)"
add(
    "ipv4_canonical",
    "SELECT page_id, (page_id % 256) * 16777216 + page_id % 65536 AS value, concat(page_id % 256, '.0.', (page_id % 65536) // 256, '.', page_id % "
    "256) AS text FROM pages",
)(
    lambda s, d: _pages(s, d).withColumn("v", parse.ipv4_value(F.concat(F.lit("0x"), F.lower(F.hex(F.col("page_id") % 256)), F.lit("."), (F.col("page_id") % 65536).cast("string")))).select("page_id", F.col("v").alias("value"), parse.ipv4_text(F.col("v")).alias("text")),
)
add("ipv4_octal", "SELECT page_id, page_id % 512 AS value FROM pages")(
    lambda s, d: _pages(s, d).select("page_id", parse.ipv4_value(F.concat(F.lit("0"), F.conv((F.col("page_id") % 512).cast("string"), 10, 8))).alias("value")),
)
add(
    "ipv6_canonical",
    "SELECT page_id, CASE WHEN page_id % 65536 = 0 THEN '1::' ELSE concat('1::', lower(hex(page_id % 65536)), ':0') END AS text FROM pages",
)(
    lambda s, d: _pages(s, d).select("page_id", parse.ipv6_canonical(F.concat(F.lit("0001:0:0:0:0:0:"), F.hex(F.col("page_id") % 65536), F.lit(":0")))["text"].alias("text")),
)
add(
    "url_host",
    "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, 'Domain' AS host_type, NULL::VARCHAR AS error FROM pages",
)(
    lambda s, d: _pages(s, d).withColumn("h", parse.url_host(F.upper(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)))).select("page_id", "h.*"),
)
add("domain_to_ascii", "SELECT page_id, concat('xn--mnchen-3ya.', lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1))) AS ascii FROM pages")(
    lambda s, d: _pages(s, d).select("page_id", parse.domain_to_ascii(F.concat(F.lit("MÜNCHEN。"), F.upper(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)))).alias("ascii")),
)
add("domain_to_unicode", "SELECT page_id, concat('münchen.', regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS text, true AS ok FROM pages")(
    lambda s, d: _pages(s, d).withColumn("r", parse.domain_to_unicode(F.concat(F.lit("xn--mnchen-3ya."), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)))).select("page_id", F.col("r.value").alias("text"), F.col("r.ok").alias("ok")),
)

# Public suffixes


def _rules(spark: SparkSession) -> DataFrame:
    return suffixes.rules(suffixes.lines_of(spark, RULE_TEXT))


_HOSTS = U + r""", s AS (SELECT page_id, host, CASE WHEN host LIKE '%.example.org' OR host = 'example.org' THEN 'example.org' ELSE regexp_extract(host, '[^.]+$') END AS suffix FROM u),
 d AS (SELECT *, string_split(host, '.') AS l, len(string_split(suffix, '.')) AS k FROM s)"""


def _suffixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.with_suffixes(_records(spark, sf_dir).select("page_id", F.col("u.host").alias("host")), "host", _rules(spark))


add("psl_suffix", _HOSTS + " SELECT page_id, host, suffix FROM d")(lambda s, d: _suffixed(s, d).select("page_id", "host", "suffix"))
add(
    "psl_registrable_domain",
    _HOSTS + " SELECT page_id, host, CASE WHEN len(l) > k THEN array_to_string(l[len(l) - k:len(l)], '.') END AS registrable_domain FROM d",
)(
    lambda s, d: _suffixed(s, d).select("page_id", "host", "registrable_domain"),
)
add(
    "psl_suffix_info",
    _HOSTS
    + " SELECT page_id, (len(l) - k)::INTEGER AS first_label_ind, (length(host) - length(suffix))::INTEGER AS first_label_pos, suffix <> "
      "'example.org' AS is_icann, suffix = 'example.org' AS is_private, false AS wildcard_rule, true AS is_rules_match FROM d",
)(
    lambda s, d: suffixes.lookup(_records(s, d).select("page_id", F.col("u.host").alias("host")), "host", _rules(s)).select("page_id", *[F.col(f"suffix_info.{n}") for n in ("first_label_ind", "first_label_pos", "is_icann", "is_private", "wildcard_rule", "is_rules_match")]),
)
add("psl_suffix_view", _HOSTS + " SELECT page_id, upper(suffix) AS suffix_view FROM d")(
    lambda s, d: suffixes.text_suffixes(_records(s, d).select("page_id", F.upper("u.host").alias("text")), "text", _rules(s)).select("page_id", "suffix_view"),
)
add(
    "psl_rule_load",
    "SELECT * FROM (VALUES ('com', 1, 2, 'ICANN'), ('net', 1, 2, 'ICANN'), ('org', 1, 2, 'ICANN'), ('uk', 1, 2, 'ICANN'), ('co.uk', 2, 2, 'ICANN'), "
    "('ck', 1, 3, 'ICANN'), ('www.ck', 2, 1, 'ICANN'), ('example.org', 2, 2, 'PRIVATE'), ('hosted.app', 2, 3, 'PRIVATE')) t(suffix, depth, kind, "
    "section)",
)(
    lambda s, d: _rules(s).select("suffix", "depth", "kind", "section"),
)
add("psl_load_status", "SELECT true AS ok")(lambda s, d: suffixes.load_status(suffixes.lines_of(s, RULE_TEXT)))

# Patterns

_P = "https://:sub.:name.example.:tld/:lang/:id(\\d+){.:ext}?"
on_pages(
    "pattern_test",
    lambda u: {"hit": match.test(compile_pattern(_P + "?*#*"), u)},
    U
    + r"SELECT page_id, scheme = 'https' AND regexp_matches(host, '^[^.]+\.[^.]+\.example\.[^.]+$') AND regexp_matches(path, "
      r"'^/[^/]+/\d+(\.[^/]+)?$') AS hit FROM u",
)
add(
    "pattern_exec_groups",
    U
    + r"SELECT page_id, split_part(host, '.', 1) AS sub, split_part(path, '/', 2) AS lang, regexp_extract(path, '^/[^/]+/(\d+)', 1) AS id, "
      r"nullif(regexp_extract(path, '\.([^/]+)$', 1), '') AS ext FROM u WHERE scheme = 'https' AND regexp_matches(host, "
      r"'^[^.]+\.[^.]+\.example\.[^.]+$') AND regexp_matches(path, '^/[^/]+/\d+(\.[^/]+)?$')",
)(
    lambda s, d: _records(s, d).withColumn("m", match.execute(compile_pattern(_P + "?*#*"), F.col("u"))).where("m IS NOT NULL").select("page_id", F.col("m.hostname.groups")["sub"].alias("sub"), *[F.col("m.pathname.groups")[g].alias(g) for g in ("lang", "id", "ext")]),
)
on_pages(
    "pattern_router",
    lambda u: {"routes": F.array_join(match.route({n: compile_pattern(p + "\\?*#*") for n, p in ROUTES.items()}, u), ",")},
    U
    + r"SELECT page_id, concat_ws(',', CASE WHEN regexp_matches(path, '^/en/[^/]+$') THEN 'english' END, CASE WHEN regexp_matches(path, "
      r"'^/de/[^/]+$') THEN 'german' END, CASE WHEN host LIKE 'blog.%' THEN 'blog' END, CASE WHEN regexp_matches(path, '^/[^/]+/\d+\.html$') THEN "
      r"'dot_html' END) AS routes FROM u",
)
add(
    "pattern_components",
    r"SELECT 'http{s}?' AS protocol, '*' AS username, '*' AS hostname, '' AS port, '/:lang/:name(\d+).html' AS pathname, true AS has_regexp_groups",
)(
    lambda s, d: (lambda p: s.createDataFrame([(p.protocol, p.username, p.hostname, p.port, p.pathname, p.has_regexp_groups)], "protocol string, username string, hostname string, port string, pathname string, has_regexp_groups boolean"))(compile_pattern(ROUTES["dot_html"])),
)

# File paths

add("file_url_from_posix", "SELECT page_id, concat('file:///data/p%20', page_id, '/%25%23%3F.html') AS href FROM pages")(
    lambda s, d: _pages(s, d).select("page_id", filepath.url_from_file_path(F.concat(F.lit("/data/p "), F.col("page_id").cast("string"), F.lit("/%#?.html")), "posix")["href"].alias("href")),
)
add("file_url_from_windows", "SELECT page_id, concat('file:///C:/p%20', page_id, '/x.html') AS href FROM pages")(
    lambda s, d: _pages(s, d).select("page_id", filepath.url_from_file_path(F.concat(F.lit("C:\\p "), F.col("page_id").cast("string"), F.lit("\\x.html")), "windows")["href"].alias("href")),
)
add("path_from_file_url", r"SELECT page_id, concat('/d ', page_id) AS posix, concat('\\h\s', page_id) AS unc FROM pages")(
    lambda s, d: _pages(s, d).select("page_id", filepath.path_from_file_url(parse.url_parse(F.concat(F.lit("file:///d%20"), F.col("page_id").cast("string"))), "posix")["path"].alias("posix"), filepath.path_from_file_url(parse.url_parse(F.concat(F.lit("file://h/s"), F.col("page_id").cast("string"))), "windows")["path"].alias("unc")),
)

# Compositions over the reference operators: joins, grouping, windows and sets are Spark's own


@add("url_equijoin", "SELECT page_id, page_id % 50 AS site FROM pages WHERE page_id % 50 < 30")
def _equijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, under URLs written in different ways, met with a list of 30 canonical URLs."""
    site = (F.col("page_id") % 50).cast("string")
    odd = F.concat(F.lit("HTTP://S"), site, F.lit(".test:80/a/../b c#f"), F.col("page_id").cast("string"))
    known = spark.range(30).select(F.col("id").alias("site"), F.concat(F.lit("http://s"), F.col("id").cast("string"), F.lit(".test/b%20c")).alias("href"))
    pages = parse.parse_urls(_pages(spark, sf_dir).select("page_id", odd.alias("odd")), "odd", "u")
    return pages.join(F.broadcast(known), R.serialize(F.col("u"), True) == F.col("href")).select("page_id", "site")


add("url_semi_allowlist", _HOSTS + " SELECT page_id FROM d WHERE suffix = 'example.org'")(
    lambda s, d: _suffixed(s, d).join(F.broadcast(s.createDataFrame([("example.org",)], "suffix string")), "suffix", "left_semi").select("page_id"),
)
add("domain_rollup", _HOSTS + " SELECT suffix, host, count(*) AS n FROM d GROUP BY ROLLUP (suffix, host)")(
    lambda s, d: _suffixed(s, d).rollup("suffix", "host").agg(F.count("*").alias("n")),
)


@add(
    "top_pages_per_domain",
    _HOSTS + " SELECT host, page_id FROM (SELECT host, page_id, row_number() OVER (PARTITION BY host ORDER BY page_id) AS r FROM d) WHERE r <= 3",
)
def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return _records(spark, sf_dir).select("page_id", F.col("u.host").alias("host")).withColumn("r", F.row_number().over(Window.partitionBy("host").orderBy("page_id"))).where("r <= 3").select("host", "page_id")


@add("url_set_ops", "SELECT url AS href FROM pages WHERE url LIKE 'https:%' EXCEPT SELECT url FROM pages WHERE url LIKE '%#%'")
def _set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _records(spark, sf_dir)
    return own.where("u.scheme = 'https'").select(F.col("u.href").alias("href")).subtract(own.where("u.fragment IS NOT NULL").select("u.href"))


@add(
    "top_registrable_domains",
    _HOSTS
    + ", r AS (SELECT DISTINCT CASE WHEN len(l) > k THEN array_to_string(l[len(l) - k:len(l)], '.') END AS registrable_domain, d.page_id FROM d) "
      "SELECT registrable_domain, count(*) AS pages FROM r GROUP BY registrable_domain",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages per registrable domain, of canonical URLs without ``utm_*`` parameters."""
    own = _records(spark, sf_dir).withColumn("u", R.with_params(F.col("u"), P.remove_if(R.search_params(F.col("u")), lambda x: x["name"].startswith("utm_"))))
    named = suffixes.with_suffixes(own.select("page_id", F.col("u.href").alias("href"), F.col("u.host").alias("host")), "host", _rules(spark))
    return named.groupBy("registrable_domain").agg(F.count("*").alias("pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _Q | cases.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | cases.oracle_sql()
