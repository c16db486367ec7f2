"""Internationalized domain names: mapping, validation, Punycode, to ASCII and to Unicode.

The mapping is derived from this Python's Unicode data (case folding and NFKC) with the exceptions that
UTS #46 names. Code points newer than that data, and joining types, are looked up in the tables of the
``regex`` package, where it is installed; else newer code points count as unassigned and are refused.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from urlmill.functions.memo import memo

try:
    import regex
except ModuleNotFoundError:
    regex = None

UNICODE_VERSION = unicodedata.unidata_version
#: Fixed values of UTS #46: kept although they fold, dots, ignored and refused code points.
DEVIATIONS = "\u00df\u03c2\u200c\u200d"
DOTS = "\u3002\uff0e\uff61"
IGNORED = re.compile(
    "[\u00ad\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b\u2060-\u2064\u206a-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0"
    "\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0100-\U000e01ef]"
)
REFUSED = re.compile("[\u0080-\u009f\u1680\u2028-\u202e\u2065-\u2069\u2ff0-\u2fff\u31ef\ufe12\ufff9-\uffff\U000e0000-\U000e00ff]")
#: Capitals newer than Unicode 15.1 and what they map to, each first code point with as many as follow.
NEW_CAPITALS = (
    (0x1C89, 0x1C8A, 1), (0xA7CB, 0x0264, 1), (0xA7CC, 0xA7CD, 1), (0xA7CE, 0xA7CF, 1), (0xA7D2, 0xA7D3, 1), (0xA7D4, 0xA7D5, 1), (0xA7DA, 0xA7DB, 1),
    (0xA7DC, 0x019B, 1), (0xA7F1, 0x0073, 1), (0x10D50, 0x10D70, 22), (0x16EA0, 0x16EBB, 25), (0x1CCD6, 0x0061, 26), (0x1CCF0, 0x0030, 10),
)
#: Arabic letters that join to the right only; the other ones join on both sides. For want of ``regex``.
RIGHT_JOINING = re.compile("[\u0622-\u0625\u0627\u0629\u062f-\u0632\u0648\u0671-\u0673\u0675-\u0677\u0688-\u0699\u06c0\u06c3-\u06cb\u06cd\u06cf\u06d2\u06d3\u06d5\u06ee\u06ef]")
BASE, T_MIN, T_MAX, SKEW, DAMP, BIAS, FIRST = 36, 1, 26, 38, 700, 72, 128
LIMIT = 0x10FFFF


class IdnaError(ValueError):
    pass


def _newer(c: str) -> str | None:
    """What a code point maps to that this Python's data doesn't have."""
    for first, to, n in NEW_CAPITALS:
        if first <= ord(c) < first + n:
            return chr(to + ord(c) - first)
    known = regex is not None and regex.match(r"[\p{L}\p{M}\p{N}\p{S}\p{P}--\p{Lu}--\p{Lt}--\p{DI}]", c, regex.V1)
    return c if known else None


@memo(65_536)
def map_char(c: str) -> str | None:
    """What a code point maps to; None if it is refused."""
    if c < "\x80":
        return c.lower()
    if c in DEVIATIONS:
        return c
    if c in DOTS:
        return "."
    if IGNORED.match(c):
        return ""
    if unicodedata.category(c) == "Cn":
        return None if REFUSED.match(c) else _newer(c)
    if REFUSED.match(c) or unicodedata.category(c) in ("Co", "Cs", "Cc", "Cf"):
        return None
    if c == "\u1e9e":
        return "\u00df"
    plain = unicodedata.normalize("NFKC", c)
    out = c if plain == c.casefold() == c else unicodedata.normalize("NFKC", plain.casefold())
    return None if "." in out else out


def _adapt(delta: int, points: int, first: bool) -> int:
    delta = delta // DAMP if first else delta // 2
    delta += delta // points
    k = 0
    while delta > (BASE - T_MIN) * T_MAX // 2:
        delta //= BASE - T_MIN
        k += BASE
    return k + (BASE - T_MIN + 1) * delta // (delta + SKEW)


def punycode_decode(text: str) -> str:
    """Strict decoding: no empty basic part before a delimiter, only basic letters, no overflow."""
    head, mark, tail = text.rpartition("-")
    if mark and not head:
        raise IdnaError("bad_input")
    out = list(head)
    if any(c >= "\x80" for c in out):
        raise IdnaError("bad_input")
    n, i, bias, at = FIRST, 0, BIAS, 0
    while at < len(tail):
        before, weight, k = i, 1, BASE
        while True:
            if at >= len(tail):
                raise IdnaError("bad_input")
            c = tail[at]
            at += 1
            digit = ord(c) - 22 if c.isdigit() and c < "\x80" else ord(c) - 97 if "a" <= c <= "z" else ord(c) - 65 if "A" <= c <= "Z" else BASE
            if digit >= BASE:
                raise IdnaError("bad_input")
            i += digit * weight
            t = min(max(k - bias, T_MIN), T_MAX)
            if digit < t:
                break
            weight *= BASE - t
            k += BASE
        bias = _adapt(i - before, len(out) + 1, before == 0)
        n += i // (len(out) + 1)
        i %= len(out) + 1
        if n > LIMIT or 0xD800 <= n <= 0xDFFF:
            raise IdnaError("overflow")
        out.insert(i, chr(n))
        i += 1
    return "".join(out)


def punycode_encode(text: str) -> str:
    return text.encode("punycode").decode("ascii")


def _joins(label: str, i: int) -> bool:
    """Whether a zero-width (non-)joiner may stand at ``i``."""
    if i and unicodedata.combining(label[i - 1]) == 9:
        return True
    if label[i] == "\u200d":
        return False

    def joining(c: str) -> str:
        if regex is not None:
            return next((t for t in "TRDL" if regex.match(rf"\p{{JT={t}}}", c)), "D" if regex.match(r"\p{JT=C}", c) else "U")
        if unicodedata.category(c) in ("Mn", "Me", "Cf"):
            return "T"
        if RIGHT_JOINING.match(c):
            return "R"
        return "D" if unicodedata.bidirectional(c) == "AL" and unicodedata.category(c) == "Lo" and c != "\u0621" else "U"

    left = next((joining(c) for c in reversed(label[:i]) if joining(c) != "T"), "U")
    right = next((joining(c) for c in label[i + 1 :] if joining(c) != "T"), "U")
    return left in ("L", "D") and right in ("R", "D")


def _bidi_ok(label: str) -> bool:
    kinds = [unicodedata.bidirectional(c) for c in label]
    while kinds and kinds[-1] == "NSM":
        kinds.pop()
    if not kinds:
        return True
    first, last, seen = unicodedata.bidirectional(label[0]), kinds[-1], set(kinds)
    neutral = {"ES", "CS", "ET", "ON", "BN", "NSM"}
    if first in ("R", "AL"):
        return seen <= {"R", "AL", "AN", "EN"} | neutral and last in ("R", "AL", "EN", "AN") and not {"EN", "AN"} <= seen
    return first == "L" and seen <= {"L", "EN"} | neutral and last in ("L", "EN")


@dataclass(frozen=True)
class Options:
    """Which optional rules hold: hyphens in the third and fourth place or at an end of a label are faults;
    so is ASCII that is no letter, digit or hyphen; the ASCII form has the lengths that names in DNS may have."""

    check_hyphens: bool = False
    std3: bool = False
    dns_length: bool = False


def options(strict: bool = False, check_hyphens: bool | None = None, std3: bool | None = None, dns_length: bool | None = None) -> Options:
    return Options(*[strict if x is None else x for x in (check_hyphens, std3, dns_length)])


def _faults(label: str, rules: Options) -> set[str]:
    """Names of the rules that a label breaks."""
    out: set[str] = set()
    if not label:
        return out
    if not unicodedata.is_normalized("NFC", label):
        out.add("not_nfc")
    if unicodedata.category(label[0])[0] == "M":
        out.add("leading_mark")
    if label.startswith("xn--"):
        out.add("invalid_ace_label")
    if rules.check_hyphens:
        out |= {"hyphen_3_4"} if label[2:4] == "--" else set()
        out |= {"leading_hyphen"} if label[0] == "-" else set()
        out |= {"trailing_hyphen"} if label[-1] == "-" else set()
    if rules.std3 and any(c < "\x80" and not (c.isalnum() or c == "-") for c in label) or any(map_char(c) != c for c in label):
        out.add("disallowed")
    if any(c in "\u200c\u200d" and not _joins(label, i) for i, c in enumerate(label)):
        out.add("context_joiner")
    return out


def process(domain: str, rules: Options = Options()) -> tuple[list[str], set[str]]:
    """The labels in Unicode, and the names of the faults met."""
    mapped: list[str] = []
    bad: set[str] = set()
    for c in domain:
        m = map_char(c)
        if m is None:
            bad.add("disallowed")
        mapped.append(c if m is None else m)
    labels, out = unicodedata.normalize("NFC", "".join(mapped)).split("."), []
    for label in labels:
        if label.startswith("xn--"):
            try:
                own = punycode_decode(label[4:])
                bad |= {"invalid_ace_label"} if not own or own.isascii() else _faults(own, rules)
                label = own if own else label
            except IdnaError:
                bad.add("punycode")
        else:
            bad |= _faults(label, rules)
        out.append(label)
    if any(unicodedata.bidirectional(c) in ("R", "AL", "AN") for label in out for c in label) and not all(_bidi_ok(label) for label in out if label):
        bad.add("bidi")
    return out, bad


def to_ascii(domain: str, rules: Options = Options()) -> str | None:
    """The ASCII form; None on failure or an empty result."""
    if domain.isascii() and rules == Options() and not re.search(r"(^|\.)xn--", domain, re.I):
        return domain.lower() or None
    labels, bad = process(domain, rules)
    if bad:
        return None
    out = [x if x.isascii() else "xn--" + punycode_encode(x) for x in labels]
    if rules.dns_length and (any(not 0 < len(x) < 64 for x in (out[:-1] if out[-1] == "" and len(out) > 1 else out)) or len(".".join(out).rstrip(".")) > 253):
        return None
    return ".".join(out) or None


def to_unicode(domain: str, rules: Options = Options()) -> tuple[str, set[str]]:
    """The Unicode form, always; and the names of the faults met."""
    labels, bad = process(domain, rules)
    return ".".join(labels), bad
