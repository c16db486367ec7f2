"""Percent-encode sets, as the ASCII characters that stay, and scheme facts."""

from __future__ import annotations

#: Fixed values of the URL Standard: special schemes and their default ports.
SPECIAL: dict[str, int | None] = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}

PRINTABLE = frozenset(map(chr, range(0x20, 0x7F)))
FRAGMENT = PRINTABLE - set(' "<>`')
QUERY = PRINTABLE - set(' "#<>')
SPECIAL_QUERY = QUERY - {"'"}
PATH = QUERY - set("?^`{}")
RAW_PATH = PATH - {"%"}
POSIX_PATH = RAW_PATH - set(":\\|")
USERINFO = PATH - set("/:;=@[\\]|")
COMPONENT = USERINFO - set("$%&+,")
C0 = PRINTABLE

SETS = {"fragment": FRAGMENT, "query": QUERY, "special_query": SPECIAL_QUERY, "path": PATH, "raw_path": RAW_PATH, "posix_path": POSIX_PATH, "userinfo": USERINFO, "component": COMPONENT, "c0": C0}

FORBIDDEN_HOST = frozenset("\0\t\n\r #/:<>?@[\\]^|")
FORBIDDEN_DOMAIN = FORBIDDEN_HOST | set(map(chr, range(0x20))) | {"%", "\x7f"}


def kept(which: str | frozenset[str]) -> frozenset[str]:
    return SETS[which] if isinstance(which, str) else frozenset(which)


def char_class(chars) -> str:
    """A regular-expression class of these characters, for Java and Python."""
    return "[" + "".join(f"\\x{ord(c):02X}" for c in sorted(chars)) + "]"
