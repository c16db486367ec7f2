"""URL patterns, compiled on the driver: text to tokens, tokens to parts, parts to regular expressions.

The regular expressions are in the Java dialect. An optional part's outer group captures, so that a group
that took no part can be told from one that matched nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from urlmill.functions import kernel
from urlmill.functions.charsets import C0, FRAGMENT, SPECIAL, SPECIAL_QUERY, USERINFO

COMPONENTS = ("protocol", "username", "password", "hostname", "port", "pathname", "search", "hash")
NAMES = (*COMPONENTS, "baseURL")
#: Fixed values of the URL Pattern Standard: escaped in regular expressions, and in pattern texts.
REGEX_MARKS, PATTERN_MARKS = set(".+*?^${}()[]|/\\"), set("+*?:{}()\\")
ANY = ".*"


class PatternError(ValueError):
    pass


@dataclass(frozen=True)
class Token:
    kind: str  # open close regexp name char escaped modifier asterisk end invalid
    at: int
    value: str


@dataclass(frozen=True)
class Part:
    kind: str  # text regexp segment any
    value: str
    modifier: str
    name: str = ""
    prefix: str = ""
    suffix: str = ""


@dataclass(frozen=True)
class Group:
    """A named group: its number, the number of the group that tells whether it took part (0: always), and
    whether an empty match counts as not taken part."""

    name: str
    number: int
    outer: int = 0
    empty_is_none: bool = False


def _starts_name(c: str) -> bool:
    return c in "$_" or c.isidentifier()


def _continues_name(c: str) -> bool:
    return c in "$_\u200c\u200d" or ("a" + c).isidentifier()


def _group_end(text: str, at: int) -> int:
    """Where the group opened before ``at`` ends; -1 if it is malformed."""
    depth, start = 1, at
    while at < len(text):
        c = text[at]
        if c > "\x7f" or at == start and c == "?":
            return -1
        if c == "\\":
            if at + 1 >= len(text) or text[at + 1] > "\x7f":
                return -1
            at += 2
            continue
        if c == ")":
            depth -= 1
            if not depth:
                return at if at > start else -1
        elif c == "(":
            depth += 1
            if text[at + 1 : at + 2] != "?":
                return -1
        at += 1
    return -1


def tokenize(text: str, strict: bool = True) -> list[Token]:
    out, at = [], 0
    plain = {"*": "asterisk", "+": "modifier", "?": "modifier", "{": "open", "}": "close"}

    def bad(value: str) -> None:
        if strict:
            raise PatternError(f"bad pattern at {at}: {text}")
        out.append(Token("invalid", at, value))

    while at < len(text):
        c, end = text[at], at + 1
        if c in plain:
            out.append(Token(plain[c], at, c))
        elif c == "\\":
            if end == len(text):
                bad(c)
            else:
                out.append(Token("escaped", at, text[end]))
                end += 1
        elif c == ":":
            while end < len(text) and (_continues_name(text[end]) if end > at + 1 else _starts_name(text[end])):
                end += 1
            if end == at + 1:
                bad(c)
            else:
                out.append(Token("name", at, text[at + 1 : end]))
        elif c == "(":
            close = _group_end(text, end)
            if close < 0:
                bad(c)
            else:
                out.append(Token("regexp", at, text[end:close]))
                end = close + 1
        else:
            out.append(Token("char", at, c))
        at = end
    return [*out, Token("end", len(text), "")]


def parse_parts(text: str, encode: Callable[[str], str], delimiter: str = "", prefix_mark: str = "") -> list[Part]:
    """The parts of one component's pattern."""
    tokens, parts = tokenize(text), []
    at, fixed, unnamed = 0, "", 0
    segment = f"[^{_regex_text(delimiter)}]+?" if delimiter else r"[\s\S]+?"
    taken: set[str] = set()

    def take(*kinds: str) -> Token | None:
        nonlocal at
        if tokens[at].kind in kinds:
            at += 1
            return tokens[at - 1]
        return None

    def flush() -> None:
        nonlocal fixed
        if fixed:
            parts.append(Part("text", encode(fixed), ""))
            fixed = ""

    def words() -> str:
        out = ""
        while t := take("char", "escaped"):
            out += t.value
        return out

    def add(prefix: str, name: Token | None, own: Token | None, suffix: str, modifier: str) -> None:
        nonlocal fixed, unnamed
        if not name and not own and not modifier:
            fixed += prefix
            return
        flush()
        if not name and not own:
            if prefix:
                parts.append(Part("text", encode(prefix), modifier))
            return
        regexp = segment if own is None else ANY if own.kind == "asterisk" else own.value
        kind = "segment" if regexp == segment else "any" if regexp == ANY else "regexp"
        called = name.value if name else str(unnamed)
        unnamed += name is None
        if called in taken:
            raise PatternError(f"two groups are called {called}")
        taken.add(called)
        parts.append(Part(kind, regexp if kind == "regexp" else "", modifier, called, encode(prefix), encode(suffix)))

    def modifier() -> str:
        t = take("modifier", "asterisk")
        return t.value if t else ""

    while True:
        char = take("char")
        name = take("name")
        own = take("regexp") or (None if name else take("asterisk"))
        if name or own:
            prefix = char.value if char else ""
            if prefix and prefix != prefix_mark:
                fixed, prefix = fixed + prefix, ""
            flush()
            add(prefix, name, own, "", modifier())
            continue
        char = char or take("escaped")
        if char:
            fixed += char.value
        elif take("open"):
            prefix = words()
            name = take("name")
            own = take("regexp") or (None if name else take("asterisk"))
            suffix = words()
            if not take("close"):
                raise PatternError(f"unclosed group: {text}")
            add(prefix, name, own, suffix, modifier())
        else:
            flush()
            if not take("end"):
                raise PatternError(f"unexpected {tokens[at].kind}: {text}")
            return parts


def _regex_text(text: str) -> str:
    return "".join("\\" + c if c in REGEX_MARKS else c for c in text)


def _pattern_text(text: str) -> str:
    return "".join("\\" + c if c in PATTERN_MARKS else c for c in text)


def _count_groups(regexp: str) -> int:
    return re.compile(_for_python(regexp)).groups


def _for_python(regexp: str) -> str:
    return re.sub(r"\(\?<(?![=!])", "(?P<", regexp).replace(r"\z", r"\Z")


def to_regex(parts: list[Part], delimiter: str = "") -> tuple[str, tuple[Group, ...]]:
    """The regular expression of a component, and its named groups."""
    segment = f"[^{_regex_text(delimiter)}]+?" if delimiter else r"[\s\S]+?"
    out, groups, number = ["^"], [], 0
    for p in parts:
        if p.kind == "text":
            out.append(_regex_text(p.value) if not p.modifier else f"(?:{_regex_text(p.value)}){p.modifier}")
            continue
        regexp = {"segment": segment, "any": ANY}.get(p.kind, p.value)
        try:
            inside = _count_groups(regexp)
        except re.error as e:
            raise PatternError(f"bad regular expression {regexp}: {e}") from e
        before, after = _regex_text(p.prefix), _regex_text(p.suffix)
        many = p.modifier in ("*", "+")
        if not p.prefix and not p.suffix:
            out.append(f"((?:{regexp}){p.modifier})" if many else f"({regexp}){p.modifier}")
            groups.append(Group(p.name, number + 1, 0, p.modifier == "?"))
            number += 1 + inside
            continue
        own = f"((?:{regexp})(?:{after}{before}(?:{regexp}))*)" if many else f"({regexp})"
        optional = p.modifier in ("?", "*")
        out.append(f"{'(' if optional else '(?:'}{before}{own}{after}){'?' if optional else ''}")
        groups.append(Group(p.name, number + 1 + optional, number + 1 if optional else 0))
        number += 1 + optional + inside * (2 if many else 1)
    return "".join(out) + r"\z", tuple(groups)


def to_pattern(parts: list[Part], delimiter: str = "", prefix_mark: str = "") -> str:
    """The normalized pattern text of a component."""
    segment = f"[^{_regex_text(delimiter)}]+?"
    out = ""
    for i, p in enumerate(parts):
        last = parts[i - 1] if i else None
        following = parts[i + 1] if i + 1 < len(parts) else None
        if p.kind == "text":
            out += _pattern_text(p.value) if not p.modifier else f"{{{_pattern_text(p.value)}}}{p.modifier}"
            continue
        named = not p.name[0].isdigit()
        grouped = bool(p.suffix) or bool(p.prefix) and p.prefix != prefix_mark
        if not grouped and named and p.kind == "segment" and not p.modifier and following and not following.prefix and not following.suffix:
            grouped = _continues_name(following.value[0]) if following.kind == "text" else following.name[0].isdigit()
        if not grouped and not p.prefix and last and last.kind == "text" and prefix_mark and last.value.endswith(prefix_mark):
            grouped = True
        body = _pattern_text(p.prefix) + (f":{p.name}" if named else "")
        if p.kind == "regexp":
            body += f"({p.value})"
        elif p.kind == "segment":
            body += "" if named else f"({segment})"
        else:
            alone = not named and (last is None or last.kind == "text" or bool(last.modifier) or grouped or bool(p.prefix))
            body += "*" if alone else "(.*)"
        if p.kind == "segment" and named and p.suffix and _continues_name(p.suffix[0]):
            body += "\\"
        body += _pattern_text(p.suffix)
        out += (f"{{{body}}}" if grouped else body) + p.modifier
    return out


# Canonical values of components


def _dummy() -> kernel.Url:
    return kernel.parse("https://dummy.invalid/")


def _must(done: bool, what: str) -> None:
    if not done:
        raise PatternError(f"bad {what}")


def canon_protocol(value: str) -> str:
    if not value:
        return value
    try:
        return kernel.parse(value + "://dummy.invalid/").scheme
    except kernel.UrlError as e:
        raise PatternError(f"bad protocol {value}") from e


def canon_user(value: str) -> str:
    return kernel.encode(value, USERINFO)


def canon_hostname(value: str) -> str:
    if not value:
        return value
    url = _dummy()
    _must(kernel.set_hostname(url, value), f"hostname {value}")
    return url.host


def canon_ipv6(value: str) -> str:
    _must(re.match(r"[0-9A-Fa-f\[\]:]*\Z", value) is not None, f"IPv6 hostname {value}")
    return value.lower()


def canon_port(value: str, protocol: str = "") -> str:
    if not value:
        return value
    url = _dummy()
    url.scheme = protocol or "dummy"
    _must(kernel._set_digits(url, kernel._plain(value)), f"port {value}")
    return "" if url.port is None else str(url.port)


def canon_pathname(value: str) -> str:
    if not value:
        return value
    url = _dummy()
    rooted = value[0] == "/"
    kernel.set_pathname(url, value if rooted else "/-" + value)
    return url.path if rooted else url.path[2:]


def canon_opaque(value: str) -> str:
    return kernel.encode(kernel._plain(value), C0)


def canon_search(value: str) -> str:
    return kernel.encode(kernel._plain(value), SPECIAL_QUERY)


def canon_hash(value: str) -> str:
    return kernel.encode(kernel._plain(value), FRAGMENT)


# Dictionaries of components


def _absolute(path: str, pattern: bool) -> bool:
    return path.startswith("/") or pattern and path[:2] in ("\\/", "{/")


def process(init: dict[str, str | None], pattern: bool) -> dict[str, str]:
    """The components that a dictionary gives, with those that its base URL hands down."""
    given = {k: v for k, v in init.items() if k in NAMES and v is not None}
    out: dict[str, str] = {}
    base = None
    keep = _pattern_text if pattern else (lambda x: x)
    if "baseURL" in given:
        try:
            base = kernel.parse(given["baseURL"])
        except kernel.UrlError as e:
            raise PatternError(f"bad base URL: {e}") from e
        lacks = lambda *names: not any(n in given for n in names)
        if lacks("protocol"):
            out["protocol"] = keep(base.scheme)
        if not pattern and lacks("protocol", "hostname", "port", "username"):
            out["username"] = base.username
            if lacks("password"):
                out["password"] = base.password
        if lacks("protocol", "hostname"):
            out["hostname"] = keep(base.host or "")
            if lacks("port"):
                out["port"] = "" if base.port is None else str(base.port)
                if lacks("pathname"):
                    out["pathname"] = keep(base.path)
                    if lacks("search"):
                        out["search"] = keep(base.query or "")
                        if lacks("hash"):
                            out["hash"] = keep(base.fragment or "")
    if "protocol" in given:
        value = given["protocol"].removesuffix(":")
        out["protocol"] = value if pattern else canon_protocol(value)
    for name in ("username", "password"):
        if name in given:
            out[name] = given[name] if pattern else canon_user(given[name])
    if "hostname" in given:
        out["hostname"] = given["hostname"] if pattern else canon_hostname(given["hostname"])
    protocol = out.get("protocol", "")
    if "port" in given:
        out["port"] = given["port"] if pattern else canon_port(given["port"], protocol)
    if "pathname" in given:
        path = given["pathname"]
        if base and not base.opaque and not _absolute(path, pattern):
            path = keep(base.path[: base.path.rfind("/") + 1]) + path
        out["pathname"] = path if pattern else canon_pathname(path) if protocol in SPECIAL or not protocol else canon_opaque(path)
    if "search" in given:
        value = given["search"].removeprefix("?")
        out["search"] = value if pattern else canon_search(value)
    if "hash" in given:
        value = given["hash"].removeprefix("#")
        out["hash"] = value if pattern else canon_hash(value)
    return out


def _split(text: str) -> dict[str, str]:
    """The components of a pattern written as one text."""
    tokens = tokenize(text, strict=False)
    out: dict[str, str] = {}
    state, start, at, depth, brackets, special = "init", 0, 0, 0, 0, False

    def is_char(i: int, c: str) -> bool:
        return 0 <= i < len(tokens) and tokens[i].value == c and tokens[i].kind in ("char", "escaped", "invalid")

    def is_query(i: int) -> bool:
        if is_char(i, "?"):
            return True
        return tokens[i].value == "?" and (i == 0 or tokens[i - 1].kind not in ("name", "regexp", "close", "asterisk"))

    def text_so_far() -> str:
        return text[tokens[start].at : tokens[at].at]

    def go(to: str, skip: int) -> None:
        nonlocal state, start, at
        order = ("protocol", "authority", "username", "password", "hostname", "port", "pathname", "search", "hash", "done")
        if state in COMPONENTS:
            out[state] = text_so_far()
        if state != "init" and to != "done":
            here, there = order.index(state), order.index(to)
            if here <= 3 and there >= 5:
                out.setdefault("hostname", "")
            if here <= 5 and there >= 7:
                out.setdefault("pathname", "/" if special else "")
            if here <= 6 and to == "hash":
                out.setdefault("search", "")
        state, at = to, at + skip
        start = at

    def back(to: str) -> None:
        nonlocal state, at
        at, state = start, to

    while True:
        t = tokens[at]
        if t.kind == "end":
            if state == "init":
                at = start
                if is_char(at, "#"):
                    go("hash", 1)
                elif is_query(at):
                    go("search", 1)
                else:
                    go("pathname", 0)
                continue
            if state == "authority":
                back("hostname")
                continue
            go("done", 0)
            break
        if t.kind == "open":
            depth, at = depth + 1, at + 1
            continue
        if depth:
            depth, at = depth - (t.kind == "close"), at + 1
            continue
        was = (state, at)
        ends_path = state in ("hostname", "port", "pathname") and is_query(at)
        if state == "init":
            if is_char(at, ":"):
                back("protocol")
                continue
        elif state == "protocol" and is_char(at, ":"):
            special = _matches_special(text_so_far())
            if is_char(at + 1, "/") and is_char(at + 2, "/"):
                go("authority", 3)
            else:
                go("authority" if special else "pathname", 1)
        elif state == "authority":
            if is_char(at, "@"):
                back("username")
                continue
            if is_char(at, "/") or is_query(at) or is_char(at, "#"):
                back("hostname")
                continue
        elif state == "username" and is_char(at, ":"):
            go("password", 1)
        elif state in ("username", "password") and is_char(at, "@"):
            go("hostname", 1)
        elif state == "hostname" and is_char(at, "["):
            brackets += 1
        elif state == "hostname" and is_char(at, "]"):
            brackets -= 1
        elif state == "hostname" and is_char(at, ":") and not brackets:
            go("port", 1)
        elif state in ("hostname", "port") and is_char(at, "/"):
            go("pathname", 0)
        elif ends_path:
            go("search", 1)
        elif state in ("hostname", "port", "pathname", "search") and is_char(at, "#"):
            go("hash", 1)
        if was == (state, at):
            at += 1
    if "hostname" in out:
        out.setdefault("port", "")
    return out


def _matches_special(protocol: str) -> bool:
    regex, _ = to_regex(parse_parts(protocol, canon_protocol))
    return any(re.match(_for_python(regex), s) for s in SPECIAL)


@dataclass(frozen=True)
class Component:
    pattern: str
    regex: str
    groups: tuple[Group, ...]
    has_regexp_groups: bool


def _component(text: str, encode: Callable[[str], str], delimiter: str = "", prefix: str = "", ignore_case: bool = False) -> Component:
    parts = parse_parts(text, encode, delimiter, prefix)
    regex, groups = to_regex(parts, delimiter)
    return Component(to_pattern(parts, delimiter, prefix), ("(?i)" if ignore_case else "") + regex, groups, any(p.kind == "regexp" for p in parts))


@dataclass(frozen=True)
class Pattern:
    """A compiled URL pattern."""

    components: dict[str, Component] = field(hash=False)

    def __getattr__(self, name: str) -> str:
        if name in COMPONENTS:
            return self.components[name].pattern
        raise AttributeError(name)

    @property
    def has_regexp_groups(self) -> bool:
        return any(c.has_regexp_groups for c in self.components.values())

    def exec(self, given: dict[str, str | None] | str, base: str | None = None) -> dict[str, dict] | None:
        """The match of a URL text or a dictionary, on the driver; None if there is none."""
        try:
            values = inputs_of(kernel.parse_with_base(given, base)) if isinstance(given, str) else dict.fromkeys(COMPONENTS, "") | process(given, pattern=False)
        except (kernel.UrlError, PatternError):
            return None
        out = {}
        for name, c in self.components.items():
            m = re.match(_for_python(c.regex), values[name])
            if not m:
                return None
            out[name] = {"input": values[name], "groups": {g.name: None if g.outer and m[g.outer] is None or g.empty_is_none and not m[g.number] else m[g.number] for g in c.groups}}
        return out

    def test(self, given: dict[str, str | None] | str, base: str | None = None) -> bool:
        return self.exec(given, base) is not None


def inputs_of(url: kernel.Url) -> dict[str, str]:
    return {"protocol": url.scheme, "username": url.username, "password": url.password, "hostname": url.host or "", "port": "" if url.port is None else str(url.port), "pathname": url.path, "search": url.query or "", "hash": url.fragment or ""}


def compile_pattern(given: str | dict[str, str | None], base: str | None = None, ignore_case: bool = False) -> Pattern:
    """Compile a pattern text (with a base URL) or a dictionary; ``PatternError`` for a bad one."""
    if isinstance(given, str):
        init: dict[str, str | None] = dict(_split(given))
        if base is not None:
            init["baseURL"] = base
        elif "protocol" not in init:
            raise PatternError("a relative pattern needs a base URL")
    else:
        if base is not None:
            raise PatternError("a dictionary names its base URL itself")
        init = given
    full = {c: "*" for c in COMPONENTS} | process(init, pattern=True)
    if full["protocol"] in SPECIAL and full["port"].lstrip("0") == str(SPECIAL[full["protocol"]]):
        full["port"] = ""
    host = full["hostname"]
    protocol = _component(full["protocol"], canon_protocol)
    special = any(re.match(_for_python(protocol.regex), s) for s in SPECIAL)
    return Pattern(
        {
            "protocol": protocol,
            "username": _component(full["username"], canon_user),
            "password": _component(full["password"], canon_user),
            "hostname": _component(host, canon_ipv6 if host[:1] == "[" or host[:2] in ("{[", "\\[") else canon_hostname, "."),
            "port": _component(full["port"], canon_port),
            "pathname": _component(full["pathname"], canon_pathname, "/", "/", ignore_case) if special else _component(full["pathname"], canon_opaque, ignore_case=ignore_case),
            "search": _component(full["search"], canon_search, ignore_case=ignore_case),
            "hash": _component(full["hash"], canon_hash, ignore_case=ignore_case),
        }
    )
