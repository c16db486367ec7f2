"""File paths and file URLs, POSIX and Windows, in plain Python."""

from __future__ import annotations

import os
import re

from urlmill.functions import kernel
from urlmill.functions.charsets import POSIX_PATH, RAW_PATH
from urlmill.functions.kernel import Url, UrlError

_WINDOWS_DRIVE = re.compile(r"[A-Za-z]:[/\\]")
_UP = re.compile(r"(?:^|[/\\])\.\.(?:[/\\]|\Z)")
_UP_POSIX = re.compile(r"(?:^|/)\.\.(?:/|\Z)")


def native() -> str:
    return "windows" if os.name == "nt" else "posix"


def url_from_path(path: str, form: str = "native") -> Url:
    """The file URL of an absolute path."""
    form = native() if form == "native" else form
    if not path:
        raise UrlError("file_empty_path")
    if form == "posix":
        if path[0] != "/" or _UP_POSIX.search(path):
            raise UrlError("file_unsupported_path")
        if "\0" in path:
            raise UrlError("null_character")
        return kernel.parse("file://" + kernel.encode(path, POSIX_PATH))
    rest, host = path, ""
    share = False
    if m := re.match(r"[/\\]{2}[?.][/\\]", path):
        rest = path[m.end() :]
        if re.match(r"(?i)unc[/\\]", rest):
            rest, share = rest[4:], True
        elif not _WINDOWS_DRIVE.match(rest):
            raise UrlError("file_unsupported_path")
    elif re.match(r"[/\\]{2}", path):
        rest, share = path[2:], True
    if share:
        m = re.match(r"([^/\\]+)(?:[/\\]([^/\\]*)(.*))?\Z", rest, re.S)
        # the share's name may be left out, but not be empty with more behind it, nor be a dot segment
        if not m or m[1] in ("?", ".") or re.match(r"[A-Za-z][:|]\Z", m[1]) or m[2] in (".", "..") or m[2] == "" and m[3]:
            raise UrlError("file_unsupported_path")
        host = m[1]
        if any(c in host for c in "/\\?#@: ") and not host.startswith("["):
            raise UrlError("file_unsupported_path")
        rest = rest[len(host) :]
    elif not _WINDOWS_DRIVE.match(rest):
        raise UrlError("file_unsupported_path")
    if _UP.search(rest):
        raise UrlError("file_unsupported_path")
    if "\0" in path:
        raise UrlError("null_character")
    return kernel.parse("file://" + host + ("" if share else "/") + kernel.encode(rest, RAW_PATH | {"\\"}))


def path_from_url(url: Url, form: str = "native") -> str:
    """The path of a file URL."""
    form = native() if form == "native" else form
    if url.scheme != "file":
        raise UrlError("not_file_url")
    if form == "posix":
        if url.host:
            raise UrlError("file_url_cannot_have_host")
        out = kernel.decode(url.path)
    else:
        out = kernel.decode(url.path).replace("/", "\\")
        if url.host:
            if url.host == ".":
                raise UrlError("file_url_unsupported_host")
            out = "\\\\" + _literal(url.host) + out
            if not _is_unc(out):
                raise UrlError("file_url_invalid_unc")
        elif m := re.match(r"\\{2,3}(?!\\)", out):
            out = "\\\\" + out[m.end() :]
            if not _is_unc(out):
                raise UrlError("file_url_invalid_unc")
        elif re.match(r"\\[A-Za-z]:(\\|\Z)", out):
            out = out[1:] + ("\\" if len(out) == 3 else "")
        else:
            raise UrlError("file_url_not_windows_path")
    if "\0" in out:
        raise UrlError("null_character")
    return out


def _literal(host: str) -> str:
    """IPv6 hosts in the spelling that Windows paths allow."""
    return host[1:-1].replace(":", "-") + ".ipv6-literal.net" if host.startswith("[") else host


def _is_unc(path: str) -> bool:
    m = re.match(r"\\\\([^\\]+)(?:\\([^\\]*)(.*))?\Z", path, re.S)
    return bool(m) and m[1] not in ("?", ".") and not re.match(r"[A-Za-z][:|]\Z", m[1]) and m[2] not in (".", "..") and not (m[2] == "" and m[3])
