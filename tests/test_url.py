"""URL rules: kernel values, native expressions against the kernel, parameters, patterns, suffixes, files."""

import json
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlmill.functions import encoding, files, idna, kernel, params, record
from urlmill.functions.batches import by_row
from urlmill.functions.charsets import SETS
from urlmill.functions.pattern import PatternError, compile_pattern
from urlmill.operators import filepath, match, parse, suffixes
from urlmill.plans import catalog
from urlmill.sources import links

#: The names of the failures. Of each, texts that fail so.
FAILURES = {
    "missing_scheme_non_relative_url": [None, "", "shop.test/cart", "/only/a/path"],
    "host_missing": ["ftp://?q", "wss://:9/", "http://ann:pw@"],
    "host_invalid_code_point": ["tag://sho|p", "tag://a<b"],
    "domain_invalid_code_point": ["http://sh%2Fop/", "ws://one two/"],
    "domain_to_ascii": ["http://\u0301shop/", "http://xn--9999999999b/"],
    "port_invalid": ["ws://shop.test:12a/"],
    "port_out_of_range": ["ftp://shop.test:65536/"],
    "ipv4_too_many_parts": ["http://9.8.7.6.5"],
    "ipv4_non_numeric_part": ["http://shop.0x1g.7/"],
    "ipv4_out_of_range_part": ["ws://10.300.1.1/", "ws://4294967296/"],
    "ipv6_unclosed": ["http://[abcd::"],
    "ipv6_invalid_compression": ["http://[:7::]/"],
    "ipv6_too_many_pieces": ["http://[0:1:2:3:4:5:6:7:8]/"],
    "ipv6_multiple_compression": ["http://[5::6::7]/"],
    "ipv6_invalid_code_point": ["http://[5::xyz]/"],
    "ipv6_too_few_pieces": ["http://[5:6]/"],
    "ipv4_in_ipv6_too_many_pieces": ["http://[0:1:2:3:4:5:6:10.1.1.1]/"],
    "ipv4_in_ipv6_invalid_code_point": ["http://[::10.01.1.1]/"],
    "ipv4_in_ipv6_out_of_range_part": ["http://[::10.1.1.999]/"],
    "ipv4_in_ipv6_too_few_parts": ["http://[::10.1.1]/"],
}
PARSED = {
    ("http://h", None): "http://h/", ("s://h", None): "s://h", (" \tHTTP://ExAmPlE.com:80/a/../b c?'q#f` ", None): "http://example.com/b%20c?%27q#f%60", ("http://h:/", None): "http://h/",
    ("https://h:80/", None): "https://h:80/", ("http://@h/", None): "http://h/", ("http://a@b@c/", None): "http://a%40b@c/", ("file://localhost/x", None): "file:///x", ("non-spec:/..//p", None): "non-spec:/.//p",
    ("data:a b ", None): "data:a b", ("data:a b  #x", None): "data:a b %20#x", ("http:foo", "http://h/a/b?q"): "http://h/a/foo", ("//x/y", "ftp://h/"): "ftp://x/y", ("?n", "http://h/p?q#f"): "http://h/p?n",
    ("", "http://h/p?q#f"): "http://h/p?q", ("#n", "mailto:x?q"): "mailto:x?q#n", ("..\\x", "http://h/a/b/c"): "http://h/a/x", ("file:///C|/a/../..", None): "file:///C:/", ("/x", "file:///C:/a"): "file:///C:/x",
    ("D|/x", "file:///C:/a"): "file:///D:/x", ("http://1.2.3/", None): "http://1.2.0.3/", ("http://0x7F.1/", None): "http://127.0.0.1/", ("http://256", None): "http://0.0.1.0/", ("http://[1:0:0:2:0:0:0:3]", None): "http://[1:0:0:2::3]/",
    ("http://FASS\u3002de/", None): "http://fass.de/", ("http://faß.de/", None): "http://xn--fa-hia.de/", ("non-spec://%C4%84%xx", None): "non-spec://%C4%84%xx", ("1:p", "https://host/path"): "https://host/1:p", ("http://%30x7f.1/", None): "http://127.0.0.1/",
}


def test_parse_columns(spark):
    rows = [(t, None, None, c) for c, texts in FAILURES.items() for t in texts] + [(t, b, h, None) for (t, b), h in PARSED.items()] + [("http://h/", "", None, "missing_scheme_non_relative_url"), ("x", "http://a b", None, "domain_invalid_code_point")]
    df = spark.createDataFrame(rows, "t string, b string, href string, code string")
    for r in df.withColumn("u", parse.url_parse(F.col("t"), F.col("b"))).collect():
        assert (r.u.href, r.u.error) == (r.href, r.code), r
    routed = parse.parse_urls(df.where("b IS NULL"), "t", "u").collect()
    assert len(routed) == df.where("b IS NULL").count()
    for r in routed:
        assert (r.u.href, r.u.error) == (r.href, r.code), r


def test_native_equals_kernel(spark):
    import random

    rng = random.Random(1)
    bits = ["a", "B-c", "%2e", ".", "..", "%2E%2e", "x y", "{}", "'\"", "<>", "^`|", "é"[:0], "~", "%zz", "[1]", "=", "&", ";"]
    texts = []
    for _ in range(1500):
        host = ".".join(rng.choice(["a", "EX", "x-1", "b_", "com", "1a", "0x1g"]) for _ in range(rng.randint(1, 3)))
        path = "".join("/" + "".join(rng.choices(bits, k=rng.randint(0, 2))) for _ in range(rng.randint(0, 5)))
        texts.append(rng.choice(["http", "HTTPS", "wss", "Ftp"]) + "://" + host + rng.choice(["", ":", ":80", ":0443", ":8080", ":65535"]) + path + rng.choice(["", "?", "?a='b c'&x=\"<\"", "?q?#"]) + rng.choice(["", "#", "#f` <x>#y"]))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    easy = df.where(parse.is_ordinary(parse.trimmed(F.col("t"))))
    assert easy.count() > 700
    both = easy.select("t", parse.native_parse(parse.trimmed(F.col("t"))).alias("n"), parse.url_parse(F.col("t")).alias("k"))
    assert not [r for r in both.collect() if r.n != r.k][:3]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aZ09:/\\?#@[]%.2eE \t|-é。ß&=", max_size=24), st.sampled_from([None, "http://h/p/q?r#s", "file:///C:/d/", "non-spec:/.//p", "about:blank", "s://u:p@h:1/x"]))
def test_href_is_a_fixed_point(text, base):
    try:
        url = kernel.parse_with_base(text, base)
    except kernel.UrlError:
        return
    assert kernel.parse(url.href()).href() == url.href()


def test_one_reading_of_the_input(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.test/x"), (2, "bad"), (3, "blob:https://a.test/x")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    for name, most in (("url_origin", 1), ("url_equals", 1), ("url_set_ops", 2), ("url_dedupe", 1)):
        plan = catalog.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == most, name  # a set operation has two sides


def test_one_worker_for_kernel_columns_side_by_side(spark):
    own = [by_row(T.StructType().add("pid", "long").add("x", "long"), lambda x, k=k: (os.getpid(), x * k)) for k in (1, 10, 100)]
    rows = spark.range(64, numPartitions=2).select("id", *[f(F.col("id") % 3 == i, F.col("id")).alias(f"c{i}") for i, f in enumerate(own)], *[f(F.lit(True), F.col("id")).alias(f"d{i}") for i, f in enumerate(own)]).collect()
    for r in rows:
        assert len({r.d0.pid, r.d1.pid, r.d2.pid}) == 1, r
        assert [c and c.x for c in (r.c0, r.c1, r.c2)] == [r.id * 10**i if r.id % 3 == i else None for i in range(3)], r
        assert [d.x for d in (r.d0, r.d1, r.d2)] == [r.id, r.id * 10, r.id * 100], r
    most = {"set_accepted": 2, "set_prefixed_path": 2, "file_url_cases": 2, "idna_options": 1, "idna_cases": 1, "file_path_cases": 1, "set_rejected": 2, "path_from_file_url": 2, "url_equals": 1}
    for name, n in most.items():
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") <= n, name


def test_native_setters_equal_kernel(spark):
    urls = ["http://u:p@h.test:81/a/b?q#f", "https://h.test/", "file:///x/y", "file://srv/x", "mailto:x", "x-y://h/p", "x-y:/p", "ws://1.2.3.4/", "no url"]
    values = ["", "a b", "#x y", "?q='1'", "%zz", "..", "/a/../b/%2e", "x/./y", "0080", "443", "80x", "65536", "x", "HTTPS", "https:", "ftp:x", "file", "x-y", "mailto", "New.TEST", "new.test:080", "xn--a", "1.2", "h:99999", "a@b:c/d", "\\\\", "a\\b", "ü", "t\tb", "http://n.test/%7E", "<>\"`{}|^", "x#y?z"]
    rows = [(u, v) for u in urls for v in values] + [(u, None) for u in urls]
    df = spark.createDataFrame(rows, "t string, v string")
    for part in kernel.SETTERS:
        u = parse.url_parse(F.col("t"))
        both = df.select("t", "v", parse.set_part(u, part, F.col("v")).alias("own"), parse._set_by_kernel(part)(F.lit(True), u, F.col("v")).alias("kernel"))
        assert not [r for r in both.collect() if r.own != r.kernel][:3], part
    links = spark.createDataFrame([(u, v) for u in [*urls, "https://h.test/a/../b/c;d?q", None] for v in [*values, "x/y?z#w", "//o.test", "/r", "?q", "#f", "http:x", "a:b", None]], "b string, t string")
    for r in parse.resolve_links(links, "t", "b", "u").withColumn("k", parse.url_parse(F.col("t"), F.col("b"))).collect():
        assert r.u == r.k, r


def test_native_hosts_and_paths_equal_kernel(spark):
    hosts = ["a.test", "A_b.TEST", "1.2", "0x1", "xn--a", "a..b", "a.", "", None, "a b", "ü", "[::1]", "a%20b", "9a", "a.9a", "0x1g"]
    df = spark.createDataFrame([(h,) for h in hosts], "t string")
    for r in df.select("t", parse.url_host(F.col("t")).alias("h"), parse.can_parse(F.concat(F.lit("http://"), F.col("t"))).alias("ok")).collect():
        assert tuple(r.h) == parse._host_of(r.t or ""), r
        assert r.ok == (r.t is not None and kernel_ok("http://" + r.t)), r
    paths = ["/", "/a", "/a b/%/ü?#", "/./a", "/a/..", "/c:/x", "/C|", "//x", "/a//b", "/\t", "/\\x|:", "a", "", None, "/a..b"]
    df = spark.createDataFrame([(p,) for p in paths], "t string")
    for r in df.select("t", filepath.url_from_file_path(F.col("t"), "posix").alias("u")).collect():
        try:
            want = parse.row_of(files.url_from_path(r.t or "", "posix"))
        except kernel.UrlError as e:
            want = parse.failed(str(e))
        assert tuple(r.u) == want, r
    urls = ["file:///a%20b+%zz%C3%BC", "file://h/x", "file:///%00", "http://h/", "bad", "file:///C:/x"]
    df = spark.createDataFrame([(p,) for p in urls], "t string")
    for r in df.select("t", filepath.path_from_file_url(parse.url_parse(F.col("t")), "posix").alias("p")).collect():
        try:
            want = (files.path_from_url(kernel.parse(r.t), "posix"), None) if r.t != "bad" else (None, "not_file_url")
        except kernel.UrlError as e:
            want = (None, str(e))
        assert tuple(r.p) == want, r


def kernel_ok(text):
    try:
        return bool(kernel.parse(text))
    except kernel.UrlError:
        return False


def test_sql_functions(spark):
    parse.register(spark)
    got = spark.sql("SELECT url_parse('HTTP://a.test').href AS a, url_parse_base('x', 'http://b.test/c/d').href AS b, url_parse('x').error AS e").first()
    assert got[:] == ("http://a.test/", "http://b.test/c/x", "missing_scheme_non_relative_url")


def test_setters(spark):
    rows = [
        ("http://h:443/", "protocol", "https", "https://h/", True), ("http://h/", "protocol", "file:", "file://h/", True), ("http://h:1/", "protocol", "file", "http://h:1/", False), ("file:///x", "protocol", "http", "file:///x", False),
        ("http://h/", "username", "a\tb", "http://a%09b@h/", True), ("file:///x", "username", "a", "file:///x", False), ("http://h/", "host", "x:99999", "http://x/", False), ("http://h/", "host", "", "http://h/", False),
        ("http://h/", "hostname", "x:1", "http://h/", False), ("http://h/", "port", "90=", "http://h:90/", True), ("http://h:9/", "port", "", "http://h/", True), ("data:x", "pathname", "y", "data:x", False),
        ("http://h/?a", "search", "??b", "http://h/??b", True), ("http://h/?a", "search", "", "http://h/", True), ("http://h/", "hash", "#a b", "http://h/#a%20b", True), ("http://h/", "href", "bad", "http://h/", False), ("bad", "href", "http://n", "http://n/", True), ("bad", "hash", "x", None, False),
    ]
    df = spark.createDataFrame(rows, "t string, part string, value string, href string, ok boolean")
    for part in kernel.SETTERS:
        for r in df.where(F.col("part") == part).withColumn("r", parse.set_part(parse.url_parse(F.col("t")), part, F.col("value"))).collect():
            assert (r.r.url.href, r.r.accepted) == (r.href, r.ok), r


def test_getters(spark):
    df = spark.createDataFrame([("http://u:p@h:81/p?#",), ("blob:https://a.com/x",), ("blob:blob:https://a/x",), ("non-spec:/..//p",), ("bad",)], "t string").withColumn("u", parse.url_parse(F.col("t")))
    got = {r.t: r for r in parse.origins(df, "u").select("t", "origin", record.search(F.col("u")).alias("s"), record.path(F.col("u")).alias("p"), *[record.part_pos(F.col("u"), n, True).alias(n) for n in ("scheme", "host", "port", "query", "fragment")]).collect()}
    assert got["blob:https://a.com/x"].origin == "https://a.com" and got["blob:blob:https://a/x"].origin == "null" and got["bad"].origin == ""
    r = got["http://u:p@h:81/p?#"]
    assert (r.s, r.p) == ("", "/p?") and tuple(r.scheme) == (0, 5) and tuple(r.port) == (13, 15) and tuple(r.query) == (18, 18) and tuple(r.fragment) == (19, 19)


def test_encoding(spark):
    texts = ["", "a b+c*~%41%zz%", "ü漢😀'\"<>`#?{}^|\\/:;=@[]$&,!()", "\x00\x1f\x7f"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, kept in SETS.items():
        assert [r[0] for r in df.select(encoding.percent_encode(F.col("t"), name)).collect()] == [kernel.encode(t, kept) for t in texts], name
    assert [r[0] for r in df.select(encoding.percent_decode(F.col("t"))).collect()] == [kernel.decode(t) for t in texts]
    assert spark.range(1).select(encoding.percent_decode(F.lit("%F0%9Fa%C2+%"))).first()[0] == "\ufffda\ufffd+%"


def test_params(spark):
    one = spark.range(1)
    show = lambda c: one.select(params.to_string(c)).first()[0]
    p = lambda q: params.parse(F.lit(q))
    assert show(p("a=b&&c&=d&a=%zz%C3%BC+x=y")) == "a=b&c=&=d&a=%25zz%C3%BC+x%3Dy"
    assert show(params.put(p("a=1&b=2&a=3"), "a", "x")) == "a=x&b=2" and show(params.put(p("a=1"), "c", "x")) == "a=1&c=x"
    assert show(params.sort(p("z=b&%EF%BF%BD=x&%F0%9F%8C%88=y&z=a&a"))) == "a=&z=b&z=a&%F0%9F%8C%88=y&%EF%BF%BD=x"
    assert one.select(params.get(p("a=1&a=2"), "b"), params.get(p("a=1&a=2"), "a"), params.has(p("a=1"), "a", "2"), F.size(params.get_all(p("a=1&a=2"), "a"))).first()[:] == (None, "1", False, 2)
    assert one.select(F.size(params.parse(F.lit(None).cast("string"))), params.to_string(params.parse(F.lit("?a"), True))).first()[:] == (0, "a=")
    u = parse.url_parse(F.lit("http://h/?a=%20b&utm_x=1#f"))
    got = one.select(record.with_params(u, params.remove_if(record.search_params(u), lambda x: x["name"].startswith("utm_"))).alias("u"), record.with_params(u, params.empty())["href"].alias("none")).first()
    assert got.u.href == "http://h/?a=+b#f" and got.none == "http://h/#f"


PATTERNS = [
    ({"hostname": "*.shop.test", "port": "008"}, {"hostname": "eu.shop.test", "port": "8"}, True), ({"protocol": "ftp", "port": "21"}, {"protocol": "ftp", "port": ""}, True), ({"hash": "t=:n"}, {"hash": "t=4"}, True),
    ("https://:shop.test/cart{/:item}?", "https://eu.test/cart", True), ("https://:shop.test/cart{/:item}?", "https://eu.test/cart/7/8", False), ("ws://h/:year(\\d{4})-:month", "ws://h/2024-05", True), ("ws://h/:year(\\d{4})-:month", "ws://h/24-05", False),
    ({"pathname": "/dir/:rest*"}, "https://h/dir/one/two", True), ({"pathname": "/dir/:rest*"}, "https://h/dir", True), ({"search": "*lang=:l"}, "https://h/?x=1&lang=de", True), ("tag\\::name", "tag:news", True),
]


@pytest.mark.parametrize("given_, text, hit", PATTERNS)
def test_patterns(spark, given_, text, hit):
    p = compile_pattern(given_)
    assert p.test(text) == hit
    if isinstance(text, str):
        u = parse.url_parse(F.lit(text))
        r = spark.range(1).select(match.test(p, u).alias("t"), match.execute(p, u).alias("m")).first()
        assert r.t == hit and (r.m is not None) == hit
        if hit:
            assert {k: {"input": v["input"], "groups": v["groups"]} for k, v in r.m.asDict(recursive=True).items()} == p.exec(text)


@pytest.mark.parametrize("bad", ["(?)", "(\\š)", "((u))", "()", "/:a/:a", "{x", "/:"])
def test_bad_patterns(bad):
    with pytest.raises(PatternError):
        compile_pattern(bad, "ws://h/")


def test_pattern_text_and_case():
    p = compile_pattern("https://h/Books/:id(\\d+)?", ignore_case=True)
    assert (p.pathname, p.port, p.search, p.has_regexp_groups) == ("/Books/:id(\\d+)?", "", "*", True) and p.test("https://h/bOOKS") and p.exec("https://h/books")["pathname"]["groups"] == {"id": None}
    assert compile_pattern("foo", "https://h/a/b").pathname == "/a/foo"
    with pytest.raises(PatternError):
        compile_pattern("foo")


def test_init_rows(spark):
    df = spark.createDataFrame([("http", "80"), ("http", "x"), ("https", "80")], "protocol string, port string")
    u = match.init_inputs(F.struct("protocol", "port"))
    assert [r[0] for r in df.select(match.test(compile_pattern({"protocol": "http", "port": ""}), u)).collect()] == [True, False, False]


RULES = """// ===BEGIN ICANN DOMAINS===
com
jp
*.kawasaki.jp
!city.kawasaki.jp
// ===END ICANN DOMAINS===
// ===BEGIN PRIVATE DOMAINS===
github.io
// ===END PRIVATE DOMAINS==="""


def test_suffixes(spark, tmp_path):
    (tmp_path / "rules.dat").write_text(RULES)
    lines = suffixes.read_lines(spark, str(tmp_path / "rules.dat"))
    table = suffixes.rules(lines)
    want = {
        "com": ("com", None), "www.example.com": ("com", "example.com"), "EXAMPLE.COM": ("com", "example.com"), "example.com.": ("com.", "example.com."), "github.io": ("github.io", None), "whatwg.github.io": ("github.io", "whatwg.github.io"),
        "sub.example.إختبار": ("xn--kgbechtv", "example.xn--kgbechtv"), "[::1]": (None, None), "a.b.kawasaki.jp": ("b.kawasaki.jp", "a.b.kawasaki.jp"), "kawasaki.jp": ("jp", "kawasaki.jp"), "x.city.kawasaki.jp": ("kawasaki.jp", "city.kawasaki.jp"), "a..com": (None, None), "1.2.3.4": (None, None), "bad host": (None, None),
    }
    df = spark.createDataFrame([(h,) for h in want] + [(None,)], "h string")
    got = {r.h: r for r in suffixes.text_suffixes(df, "h", table).collect()}
    assert {h: (r.suffix, r.registrable_domain) for h, r in got.items() if h} == want and got[None].suffix is None
    r = suffixes.text_suffixes(spark.createDataFrame([("a。b。eXample。com",)], "h string"), "h", table).first()
    assert r.registrable_view == "eXample。com"
    assert suffixes.load_status(lines).first().ok and not suffixes.load_status(suffixes.lines_of(spark, RULES + "\nbad rule")).first().ok and not suffixes.load_status(suffixes.lines_of(spark, "// ===BEGIN ICANN DOMAINS===\ncom")).first().ok
    assert suffixes.same_rules(table, suffixes.rules(suffixes.lines_of(spark, RULES))) and not suffixes.same_rules(table, suffixes.rules(suffixes.lines_of(spark, "com")))


FILES = [
    ("/srv/my docs/50%.txt", "posix", "file:///srv/my%20docs/50%25.txt"), ("/mnt/a\\b:c", "posix", "file:///mnt/a%5Cb%3Ac"), ("docs/x", "posix", "file_unsupported_path"), ("/srv/../x", "posix", "file_unsupported_path"), ("", "windows", "file_empty_path"), ("/srv\0", "posix", "null_character"),
    ("e:/My Docs\\x#1", "windows", "file:///e:/My%20Docs/x%231"), ("\\\\nas\\films\\x", "windows", "file://nas/films/x"), ("//nas/films", "windows", "file://nas/films"), ("\\\\?\\e:\\x", "windows", "file:///e:/x"), ("\\\\.\\UNC\\nas\\x", "windows", "file://nas/x"),
    ("\\\\nas\\.\\x", "windows", "file_unsupported_path"), ("e:x", "windows", "file_unsupported_path"), ("e:\\x\\..\\y", "windows", "file_unsupported_path"), ("e:\\\0", "windows", "null_character"),
]
PATHS = {
    "file:///e:": "e:\\", "file:///e%3A/x%20y": "e:\\x y", "file://nas/films/x": "\\\\nas\\films\\x", "file:////nas/x": "\\\\nas\\x", "file://[7::]/x": "\\\\7--.ipv6-literal.net\\x",
    "file:///srv/x": "file_url_not_windows_path", "file://nas/./x": "\\\\nas\\x", "file:///e:/%00": "null_character", "ftp://nas/x": "not_file_url",
}


def test_file_paths():
    def run(f, *a):
        try:
            out = f(*a)
            return out if isinstance(out, str) else out.href()
        except kernel.UrlError as e:
            return str(e)

    for path, form, want in FILES:
        assert run(files.url_from_path, path, form) == want, path
    for url, want in PATHS.items():
        assert run(files.path_from_url, kernel.parse(url), "windows") == want, url
    assert run(files.path_from_url, kernel.parse("file://h/p"), "posix") == "file_url_cannot_have_host"


def test_idna():
    assert idna.to_ascii("=\u0338") == "xn--1ch" and idna.to_ascii("<\u00ad\u0338") == "xn--gdh" and idna.to_ascii("xn--a") is None and idna.to_ascii("a\u200cb") is None
    assert idna.to_ascii("إختبار") == "xn--kgbechtv" and idna.to_ascii("אa") is None and idna.to_ascii("-a", idna.options(True)) is None and idna.to_ascii("-a") == "-a"
    assert idna.to_unicode("xn--mnchen-3ya.DE") == ("münchen.de", set()) and idna.to_unicode("xn--a.x")[1]
    for bad in ("-", "a-é", "9999999999b", "a!"):
        with pytest.raises(idna.IdnaError):
            idna.punycode_decode(bad)
    assert idna.punycode_decode(idna.punycode_encode("bücher漢")) == "bücher漢"


def test_addresses(spark):
    texts = {"127.0.0.1": 2130706433, "0x7f.1": 2130706433, "017700000001": 2130706433, "256": 256, "1.2.3.": 16908291, "1.2.3.4.5": None, "1.256.1": None, "0x": 0, "08": None, "4294967296": None, "": None, "a": None, "00000000000000000001": 1}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in df.select("t", parse.ipv4_value(F.col("t"))).collect()} == texts
    got = spark.range(1).select(parse.ipv4_text(F.lit(4294967295)), parse.ipv6_canonical(F.lit("1:2:0:0:3:0:0:0"))["text"], parse.ipv6_canonical(F.lit("::FFFF:1.2.3.4"))["text"], parse.ipv6_canonical(F.lit("1"))["error"]).first()
    assert got[:] == ("255.255.255.255", "1:2:0:0:3::", "::ffff:102:304", "ipv6_too_few_pieces")


def test_sources_and_streams(spark, tmp_path):
    (tmp_path / "s.txt").write_text('COMMENT: x\nBASE: http://h/a\nURL: b c\nURL: "\\u00fc"\nBASE:\nURL: bad\n')
    rows = links.read_samples(spark, str(tmp_path / "s.txt")).orderBy("line_no").collect()
    assert [(r.base, r.url) for r in rows] == [("http://h/a", "b c"), ("http://h/a", "ü"), (None, "bad")]
    shown = [json.loads(r[0]) for r in links.as_json(links.read_samples(spark, str(tmp_path / "s.txt"))).collect()]
    assert sum(x.get("failure", False) for x in shown) == 1 and {x.get("href") for x in shown} == {"http://h/b%20c", "http://h/%C3%BC", None}
    from urlmill.streaming import urls

    spark.createDataFrame([("http://A.com/?utm_x=1&b=2",), ("bad",)], "url string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string").json(str(tmp_path / "in"))
    query = urls.canonical(stream, "url", suffixes.rules(suffixes.lines_of(spark, "com"))).writeStream.format("memory").queryName("seen").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.href, r.registrable_domain) for r in spark.table("seen").collect()} == {("http://a.com/?b=2", "a.com"), (None, None)}
