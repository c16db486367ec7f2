"""Percent-encoding and UTF operators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urlmill.functions.charsets import COMPONENT, PRINTABLE, char_class, kept

#: What url_encode leaves alone.
_FORM_KEPT = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789*-._")


def percent_encode(text: Column, which: str | frozenset[str]) -> Column:
    """Percent-encodes all but the characters of a set (a name in ``charsets.SETS``, or the characters).

    Everything is form-encoded; then the sign of each escape that stays is escaped itself, and one
    decoding takes back the others. Letters and digits are always kept.
    """
    own = kept(which)
    back = "|".join(f"{ord(c):02X}" for c in sorted(own - _FORM_KEPT - {" "}))
    out = F.regexp_replace(F.url_encode(text), f"%(?!{back})" if back else "%", "%25")
    if " " not in own:
        out = F.replace(out, F.lit("+"), F.lit("%2520"))
    for c in sorted(set("*-._") - own):
        out = F.replace(out, F.lit(c), F.lit(f"%25{ord(c):02X}"))
    return F.when(text.rlike(f"^{char_class(own)}*\\z"), text).otherwise(F.url_decode(out))


def encode_url_component(text: Column) -> Column:
    return percent_encode(text, COMPONENT)


def percent_decode(text: Column) -> Column:
    """Decodes what is well-formed, keeps other ``%`` signs and ``+``; invalid UTF-8 becomes U+FFFD."""
    guarded = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(text.contains("%"), F.url_decode(guarded)).otherwise(text)


def form_encode(text: Column) -> Column:
    return F.url_encode(text)


def form_decode(text: Column) -> Column:
    return F.when(text.rlike("[%+]"), F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))).otherwise(text)


def fix_utf8(text: Column) -> Column:
    return F.make_valid_utf8(text)


def utf8_text(data: Column, charset: str = "UTF-8") -> Column:
    """Text from bytes in another encoding (``UTF-16LE``, ``UTF-16BE``, ``UTF-8``)."""
    return F.make_valid_utf8(data.cast("string")) if charset.upper() == "UTF-8" else F.decode(data, charset)


def code_units(text: Column) -> Column:
    """A key that orders texts by UTF-16 code unit."""
    return F.hex(F.encode(text, "UTF-16BE"))


def custom_set(base: str | frozenset[str] = PRINTABLE, include: str = "", exclude: str = "") -> frozenset[str]:
    return frozenset((kept(base) | set(include)) - set(exclude))
