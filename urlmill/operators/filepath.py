"""File path and file URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlmill.functions import files, kernel
from urlmill.functions.batches import by_row, struct_of
from urlmill.functions.charsets import POSIX_PATH
from urlmill.functions.encoding import percent_decode, percent_encode
from urlmill.functions.record import RECORD
from urlmill.operators.parse import _record, failed, row_of


def _posix_record(path: Column) -> Column:
    none = F.lit(None).cast("string")
    own = {"scheme": F.lit("file"), "username": F.lit(""), "password": F.lit(""), "host": F.lit(""), "host_type": F.lit("Empty"), "port": none.cast("int")}
    return _record(own | {"path": percent_encode(path, POSIX_PATH), "opaque_path": F.lit(False), "query": none, "fragment": none, "error": none})


def url_from_file_path(path: Column, form: str = "native") -> Column:
    """Records of file paths (``posix``, ``windows`` or ``native``, this driver's); null is an empty path.

    POSIX paths without dot segments, drives or control characters are converted by built-in expressions.
    """

    def url(p: str | None) -> tuple:
        try:
            return row_of(files.url_from_path(p or "", form))
        except kernel.UrlError as e:
            return failed(str(e))

    form = files.native() if form == "native" else form
    easy = F.coalesce(path.rlike(r"^/[^\x00-\x1F\x7F]*\z") & ~path.rlike(r"(^|/)\.\.?(/|$)") & ~path.rlike(r"^/[A-Za-z][:|](/|$)"), F.lit(False)) if form == "posix" else F.lit(False)
    return F.when(easy, _posix_record(path)).otherwise(by_row(RECORD, url)(~easy, path))


def path_from_file_url(record: Column, form: str = "native") -> Column:
    """``struct(path, error)`` of file URL records; POSIX paths without control characters by built-in expressions."""
    kind = struct_of(path=T.StringType(), error=T.StringType())

    def back(h: str | None) -> tuple:
        try:
            return (files.path_from_url(kernel.parse(h), form), None) if h else (None, "not_file_url")
        except kernel.UrlError as e:
            return None, str(e)

    form = files.native() if form == "native" else form
    easy = F.coalesce((record["scheme"] == "file") & (record["host"] == "") & ~record["path"].rlike("(?i)%00"), F.lit(False)) if form == "posix" else F.lit(False)
    own = F.struct(percent_decode(record["path"]).alias("path"), F.lit(None).cast("string").alias("error"))
    return F.when(easy, own).otherwise(by_row(kind, back)(~easy, record["href"]))
