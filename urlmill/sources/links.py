"""Sample files of URLs with bases, and records written as JSON objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urlmill.functions import record as R
from urlmill.operators.parse import parse_urls, url_parse


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(path, line_no, base, url)`` of text files with ``COMMENT:``, ``BASE:`` and ``URL:`` lines.

    A base holds for the URLs below it in its file; a URL may be written as a JSON string.
    """
    return samples(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\n")).alias("line_no", "line")))


def samples(lines: DataFrame) -> DataFrame:
    """As ``read_samples``, of rows ``(path, line_no, line)``."""
    base = F.when(F.col("line").startswith("BASE:"), F.trim(F.expr("substr(line, 6)")))
    below = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    raw = F.trim(F.expr("substr(line, 5)"))
    url = F.when(raw.startswith('"'), F.get_json_object(F.concat(F.lit('{"u":'), raw, F.lit("}")), "$.u")).otherwise(raw)
    known = lines.withColumn("base", F.last(base, ignorenulls=True).over(below))
    return known.where(F.col("line").startswith("URL:")).select("path", "line_no", F.when(F.col("base") != "", F.col("base")).alias("base"), url.alias("url"))


def as_json(df: DataFrame, url: str = "url", base: str = "base", keep: list[str] | None = None) -> DataFrame:
    """One JSON object a row: the components of a URL, or ``failure``. keep: columns that stay beside it."""
    u = F.col("__u")
    parts: list[Column] = [F.col(url).alias("input"), F.col(base).alias("base")]
    getters = {"href": R.href, "origin": R.origin, "protocol": R.protocol, "username": R.username, "password": R.password, "host": R.host, "hostname": R.hostname, "port": R.port, "pathname": R.pathname, "search": R.search, "hash": R.hash}
    parts += [F.when(R.is_valid(u), g(u)).alias(n) for n, g in getters.items()]
    parts.append(F.when(~R.is_valid(u), F.lit(True)).alias("failure"))
    return df.withColumn("__u", url_parse(F.col(url), F.col(base))).select(*(keep or []), F.to_json(F.struct(*parts)).alias("value"))


def write_json(df: DataFrame, path: str, url: str = "url", base: str = "base") -> None:
    as_json(df, url, base).write.text(path)


def write_hrefs(df: DataFrame, path: str, url: str = "url") -> None:
    """Canonical URLs, one a line; failed ones are left out."""
    parse_urls(df, url, "__u").where("__u.error IS NULL").select("__u.href").write.text(path)
