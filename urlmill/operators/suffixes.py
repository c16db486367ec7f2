"""Public suffixes and registrable domains: a rule table joined to hosts.

A host's suffixes of one, two, ... labels are looked up by as many broadcast joins as the rules are deep, so
there is no shuffle and the lookup works on streams as well. The rule table's size is checked before it is
broadcast; a larger one is joined by Spark's own choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urlmill.operators.parse import url_host

#: Rules of the table that may be broadcast (about 40 bytes each).
MAX_BROADCAST = 200_000
DOTS = "[.\u3002\uff0e\uff61]"
RULES = "suffix string, depth int, kind int, section string, line_no long"
#: A rule's kind: the labels that its suffix takes are its depth plus kind - 2.
EXCEPTION, NORMAL, WILDCARD = 1, 2, 3


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(line_no, line)`` of a rule file, split at line feeds only."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def lines_of(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(i, x) for i, x in enumerate(text.split("\n"))], "line_no int, line string")


def parse_rules(lines: DataFrame) -> DataFrame:
    """All rule lines with their section; ``error`` tells of a rule that is no host."""
    marker = F.regexp_extract("line", "^// ===(BEGIN|END) (ICANN|PRIVATE) DOMAINS===", 1)
    section = F.regexp_extract("line", "^// ===(?:BEGIN|END) (ICANN|PRIVATE) DOMAINS===", 1)
    state = F.when(marker == "BEGIN", section).when(marker == "END", F.lit(""))
    sofar = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a rule file is one small table
    kinds = F.when(F.col("line").startswith("*."), WILDCARD).when(F.col("line").startswith("!"), EXCEPTION).otherwise(NORMAL)
    marked = lines.withColumn("section", F.last(state, ignorenulls=True).over(sofar))
    rules = marked.where((F.col("line") != "") & ~F.col("line").startswith("//")).withColumn("kind", kinds)
    named = rules.withColumn("h", url_host(F.regexp_replace("line", r"^(\*\.|!)", "")))
    host = F.col("h.host")
    section = F.when(F.col("section") != "", F.col("section"))
    depth = F.size(F.split(host, r"\."))
    return named.select(
        F.col("line_no").cast("long"), "line", host.alias("suffix"), depth.alias("depth"), "kind", section.alias("section"), F.col("h.error").alias("error")
    )


def rules(lines: DataFrame) -> DataFrame:
    """The rule table: valid rules, of the same suffix the last line's.

    It is made once, here: up to ``MAX_BROADCAST`` rules come to the driver and are a constant from then on.
    """
    last = Window.partitionBy("suffix").orderBy(F.desc("line_no"))
    good = parse_rules(lines).where("error IS NULL").withColumn("r", F.row_number().over(last)).where("r = 1")
    table = good.select("suffix", "depth", "kind", "section", "line_no")
    few = table.limit(MAX_BROADCAST + 1).collect()
    return lines.sparkSession.createDataFrame(few, RULES) if len(few) <= MAX_BROADCAST else table


def load_status(lines: DataFrame) -> DataFrame:
    """One row ``ok``: no bad rule and no section left open."""
    closed = lines.where(F.col("line").rlike("^// ===(BEGIN|END) (ICANN|PRIVATE) DOMAINS===")).agg(F.coalesce(F.max_by(F.col("line").contains("===END"), F.col("line_no")), F.lit(True)).alias("closed"))
    bad = parse_rules(lines).agg(F.count(F.col("error")).alias("bad"))
    return closed.join(F.broadcast(bad)).select((F.col("closed") & (F.col("bad") == 0)).alias("ok"))


def same_rules(a: DataFrame, b: DataFrame) -> bool:
    a, b = (x.select("suffix", "kind", "section") for x in (a, b))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def lookup(df: DataFrame, host: str, table: DataFrame, to: str = "suffix_info") -> DataFrame:
    """``df`` with ``struct<labels_in_suffix, first_label_ind, first_label_pos, is_icann, is_private,
    wildcard_rule, is_rules_match>`` of a normalized host; null without an answer.

    One trailing dot does not count; a host with an empty label has no answer; without a rule the last
    label is the suffix.
    """
    facts = table.agg(F.max("depth").alias("depth"), F.count("*").alias("n")).first()
    small = table.select("suffix", "kind", "section")
    small = F.broadcast(small) if facts["n"] <= MAX_BROADCAST else small
    labels = F.split(F.regexp_replace(F.col(host), r"\.\z", ""), r"\.")
    out = df.withColumn("__l", labels).withColumn("__n", F.size("__l"))
    best = F.lit(None).cast("struct<depth:int,kind:int,section:string>")
    for k in range(1, (facts["depth"] or 0) + 1):
        own = F.when(F.col("__n") >= k, F.array_join(F.slice("__l", F.greatest(F.col("__n") - (k - 1), F.lit(1)), F.lit(k)), "."))
        of_depth = small.select(F.col("suffix").alias(f"__t{k}"), F.struct(F.lit(k).alias("depth"), "kind", "section").alias(f"__r{k}"))
        out = out.withColumn(f"__s{k}", own).join(of_depth, F.col(f"__s{k}") == F.col(f"__t{k}"), "left").drop(f"__t{k}", f"__s{k}")
        rule = F.col(f"__r{k}")
        best = F.when(rule.isNotNull() & ((rule["kind"] != WILDCARD) | (F.col("__n") > k)), rule).otherwise(best)
    out = out.withColumn("__best", best)
    rule = F.col("__best")
    taken = F.when(rule.isNull(), 1).otherwise(rule["depth"] + rule["kind"] - 2)
    first = F.col("__n") - taken
    good = (F.col(host) != "") & ~F.array_contains("__l", "") & (taken > 0) & (first >= 0)
    place = F.aggregate(F.slice("__l", F.lit(1), F.greatest(first, F.lit(0))), F.lit(0), lambda a, x: a + F.length(x) + 1)
    info = F.struct(
        taken.cast("int").alias("labels_in_suffix"), first.cast("int").alias("first_label_ind"), place.cast("int").alias("first_label_pos"),
        F.coalesce(rule["section"] == "ICANN", F.lit(False)).alias("is_icann"), F.coalesce(rule["section"] == "PRIVATE", F.lit(False)).alias("is_private"),
        F.coalesce(rule["kind"] == WILDCARD, F.lit(False)).alias("wildcard_rule"), rule.isNotNull().alias("is_rules_match"),
    )
    drop = [c for c in out.columns if c.startswith("__r") or c in ("__l", "__n", "__best")]
    return out.withColumn(to, F.when(F.coalesce(good, F.lit(False)), info)).drop(*drop)


def label_pos(text: Column, index: Column) -> Column:
    """Where a label begins, in characters; ideographic full stops separate labels too."""
    return F.aggregate(F.slice(F.split(text, DOTS), F.lit(1), F.greatest(index, F.lit(0))), F.lit(0), lambda a, x: a + F.length(x) + 1)


def suffix_of(host: Column, info: Column) -> Column:
    """The public suffix of a host (any spelling) by its info; null without an answer. A trailing dot stays."""
    return F.when(info.isNotNull(), F.substr(host, label_pos(host, info["first_label_ind"]) + 1))


def registrable_domain(host: Column, info: Column) -> Column:
    """The suffix and one label more; null if there is none."""
    return F.when(info["first_label_ind"] > 0, F.substr(host, label_pos(host, info["first_label_ind"] - 1) + 1))


def with_suffixes(df: DataFrame, host: str, table: DataFrame) -> DataFrame:
    """``df`` with ``suffix`` and ``registrable_domain`` of a normalized domain column."""
    own = lookup(df, host, table, "__info")
    return own.withColumn("suffix", suffix_of(F.col(host), F.col("__info"))).withColumn("registrable_domain", registrable_domain(F.col(host), F.col("__info"))).drop("__info")


def text_suffixes(df: DataFrame, text: str, table: DataFrame) -> DataFrame:
    """For hosts in any spelling: ``suffix`` and ``registrable_domain`` normalized, and ``suffix_view`` and
    ``registrable_view`` as parts of the text itself. Addresses and bad hosts have none."""
    parsed = df.withColumn("__h", url_host(F.col(text))).withColumn("__host", F.when(F.col("__h.host_type") == "Domain", F.col("__h.host")))
    own = lookup(parsed, "__host", table, "__info")
    i = F.col("__info")
    return own.select(*df.columns, suffix_of(F.col("__host"), i).alias("suffix"), registrable_domain(F.col("__host"), i).alias("registrable_domain"), suffix_of(F.col(text), i).alias("suffix_view"), registrable_domain(F.col(text), i).alias("registrable_view"))
