"""The same operators on streams: all are row-local, and suffix lookup is a stream-static broadcast join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlmill.functions import params as P
from urlmill.functions import record as R
from urlmill.operators.parse import parse_urls
from urlmill.operators.suffixes import with_suffixes


def canonical(df: DataFrame, url: str, rules: DataFrame, tracking: str = "utm_") -> DataFrame:
    """A stream or table with ``href`` (without tracking parameters), ``error``, ``host``, ``suffix`` and ``registrable_domain``."""
    u = F.col("__u")
    own = parse_urls(df, url, "__u").withColumn("__u", R.with_params(u, P.remove_if(R.search_params(u), lambda x: x["name"].startswith(tracking))))
    named = own.select("*", u["href"].alias("href"), u["error"].alias("error"), F.when(u["host_type"] == "Domain", u["host"]).alias("host")).drop("__u")
    return with_suffixes(named, "host", rules)


def domain_counts(df: DataFrame, time: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Windowed counts per registrable domain of a canonical stream with an event time."""
    return df.withWatermark(time, late).groupBy(F.window(time, width), "registrable_domain").agg(F.count("*").alias("n"))
