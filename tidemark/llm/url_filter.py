"""URL rules as nested intervals of reversed-host keys, matched by a sorted sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import lower_ascii, stored


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))


def _reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def _key(labels: Column, path: Column) -> Column:
    """``www.example.org`` with ``/a`` becomes ``org.example.www./a``: no label holds a slash."""
    return F.concat(F.concat_ws(".", labels), F.lit("."), path)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """Each page with host, path, the longest rule that fits its url, and the verdict.

    ``rules`` has host, path and verdict. A rule fits its host and all
    subdomains if the url's path starts with the rule's; the longest host and
    path together wins, between equals the longer host. Of one rule with two
    verdicts the alphabetically last holds (block before allow). Rules without
    host or verdict are left out, a null path is empty. A null url, or one
    without ``://``, has an empty host that no rule fits. Without a rule the
    verdict is ``default`` and the rule null. Input columns called host, path,
    rule or verdict are replaced; repeated pages stay repeated.

    With reversed hosts a rule covers one interval of keys, and intervals nest
    or are apart. Sites (distinct host and path) get a key for each of their
    parent hosts; keys and interval ends are sorted together and cut into
    slices of equal size. The sweep over a slice carries the stack of open
    rules, beginning with what earlier slices left open.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    pages = pages.select(
        *(F.col(f"`{c}`") for c in pages.columns),
        url_host(F.col(url_col)).alias("host"),
        url_path(F.col(url_col)).alias("path"),
    )
    rules = (
        rules.where("host <> '' AND verdict IS NOT NULL")
        .select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .select("*", _reversed_labels(F.col("host")).alias("labels"))
        .select(
            _key(F.col("labels"), F.col("path")).alias("key"),
            F.size("labels").alias("depth"),
            F.struct(
                F.char_length(F.concat("host", "path")).alias("length"),
                F.char_length("host").alias("host_length"),
                F.concat("host", "path").alias("rule"),
                "verdict",
            ).alias("entry"),
        )
    )
    deepest = rules.agg(F.max("depth")).first()[0]
    if deepest is None:
        return pages.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    swept = _sweep(_events(rules), _points(pages, deepest))
    best = (
        swept.where("entry IS NOT NULL")
        .groupBy("host", "path").agg(F.max("entry").alias("entry"))
        .select("host", "path", "entry.rule", "entry.verdict")
    )
    return (
        pages.join(best, ["host", "path"], "left")
        .select(*(F.col(f"`{c}`") for c in pages.columns), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    )


def _events(rules: DataFrame) -> DataFrame:
    """At the begin of a rule's interval the stack with it on top, at its end the stack below it."""
    outer = rules.select(F.col("key").alias("outer_key"), F.col("entry").alias("outer"))
    stacks = (
        rules.select("key", F.explode(F.sequence(F.lit(1), F.char_length("key"))).alias("n"))
        .select("key", F.substring("key", F.lit(1), F.col("n")).alias("outer_key"), "n")
        .join(outer, "outer_key")
        .groupBy("key")
        .agg(F.reverse(F.array_sort(F.collect_list(F.struct("n", "outer")))).alias("stack"))
        .select("key", F.transform("stack", lambda x: x["outer"]).alias("stack"))
    )
    begin, end = F.col("key").cast("binary"), F.concat(F.col("key").cast("binary"), F.unhex(F.lit("FF")))
    below = F.slice("stack", F.lit(2), F.size("stack"))
    return stacks.select(
        F.explode(F.array(
            F.struct(begin.alias("at"), F.col("stack").alias("stack")),
            F.struct(end.alias("at"), below.alias("stack")),
        )).alias("event")
    ).select("event.at", F.lit("").alias("host"), F.lit("").alias("path"), "event.stack")


def _points(pages: DataFrame, deepest: int) -> DataFrame:
    """A key for each parent host, up to the number of labels of the deepest rule."""
    return (
        pages.where("host <> ''").select("host", "path").distinct()
        .withColumn("labels", _reversed_labels(F.col("host")))
        .withColumn("depth", F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(deepest)))))
        .select(
            _key(F.slice("labels", F.lit(1), F.col("depth")), F.col("path")).cast("binary").alias("at"),
            "host", "path",
            F.lit(None).alias("stack"),
        )
    )


def _sweep(events: DataFrame, points: DataFrame) -> DataFrame:
    """Each point with the top of the stack of rules that are open there."""
    kind = F.col("stack").isNull().cast("int")
    cut = (
        events.unionByName(points)
        .repartitionByRange("at", kind, "host")
        .withColumn("slice", F.spark_partition_id())
    )
    cut = stored(cut, "url-slices")
    left_open = (
        cut.groupBy("slice").agg(F.max_by("stack", F.when(F.col("stack").isNotNull(), F.col("at"))).alias("stack"))
        .select(
            "slice",
            F.last("stack", ignorenulls=True)
            .over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
        )
    )
    order = Window.partitionBy("slice").orderBy("at", kind)
    open_here = F.last("stack", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        cut.withColumn("open", open_here).where("stack IS NULL")
        .join(left_open, "slice", "left")
        .select("host", "path", F.get(F.coalesce("open", "carried"), F.lit(0)).alias("entry"))
    )
