"""URL rules by a sort-merge range join: host keys, rule intervals, one sorted sweep.

A host's key is its labels in reverse, each ended by a slash (no host contains one), so
`a.example.net` becomes `net/example/a/` and the hosts under a rule are the interval of keys
that start with the rule's key. Such intervals are nested or disjoint. Where one opens or
closes, the stack of rules that hold from there on changes: these boundaries are a sorted
table. URLs and boundaries are sorted together and swept once; every URL takes the stack of the
last boundary before it, and from this stack the longest rule whose path starts its own.

The sweep is cut into lanes by a hash of the URL rows, so no host, however frequent, decides the
size of a task. Long rule lists are cut into blocks first: a boundary whose key's hash says so begins one, about
every BLOCK_MARKS boundaries. A first sweep over these beginnings alone gives each URL and each boundary its block;
the second sweeps each block by itself, a block of many URLs in several lanes. So the lanes share the few
beginnings, and a boundary is repeated only as often as the URLs around it fill lanes.

Defined results: a null URL or one without `://` has empty host and path and fits no rule. Equal
rules with different verdicts: block wins. Repeated rows stay repeated. Rules with a null or empty
host are dropped; a null path is the empty path.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedgate.llm.common import ascii_lower, literal_rows
from feedgate.sources.scratch import save

#: URLs of one lane of the sweep, and lanes at least.
LANE_ROWS = 1_000_000
MIN_LANES = 64
#: Boundaries of a block, on average.
BLOCK_MARKS = 256

_STACK = "array<struct<length:int,host_length:int,rule:string,path:string,verdict:string>>"


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) triples as a table."""
    return literal_rows(
        spark, ("verdict", "host", "path"), rules, "verdict:string,host:string,path:string"
    )


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without a scheme."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, "[.]"))


def _key(labels: Column) -> Column:
    return F.concat(F.array_join(labels, "/"), F.lit("/"))


def boundaries(rules: DataFrame) -> DataFrame:
    """(key, stack): the rules that hold from this key on, outermost first, until the next row."""
    rules = rules.select(
        F.lower("verdict").alias("verdict"),
        ascii_lower(F.col("host")).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
    ).where(F.length("host") > 0)
    rule = F.concat("host", "path")
    nodes = (
        rules.select(
            _key(_labels(F.col("host"))).alias("key"),
            _labels(F.col("host")).alias("labels"),
            F.struct(
                F.length(rule).alias("length"),
                F.length("host").alias("host_length"),
                rule.alias("rule"),
                "path",
                "verdict",
            ).alias("item"),
        )
        .groupBy("key")
        .agg(F.first("labels").alias("labels"), F.array_sort(F.collect_set("item")).alias("items"))
    )
    depth = F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("depth")
    above = nodes.select("key", "labels", depth).select(
        "key", "depth", _key(F.slice("labels", 1, F.col("depth"))).alias("ancestor")
    )
    owners = nodes.select(F.col("key").alias("ancestor"), "items")
    stacks = (
        above.join(owners, "ancestor")
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("depth", "ancestor", "items"))).alias("levels"))
    )
    full = F.flatten(F.transform("levels", lambda level: level["items"]))
    outer = F.flatten(
        F.transform(F.filter("levels", lambda level: level["ancestor"] != F.col("key")), lambda level: level["items"])
    )
    # A slash is followed by the digit 0 in byte order: no key of the interval sorts behind that.
    closing = F.concat(F.substring("key", 1, F.length("key") - 1), F.lit("0"))
    return stacks.select(
        F.explode(
            F.array(
                F.struct(F.col("key").alias("key"), full.cast(_STACK).alias("stack")),
                F.struct(closing.alias("key"), outer.cast(_STACK).alias("stack")),
            )
        ).alias("b")
    ).select("b.key", "b.stack")


def _last_before(rows: DataFrame, marks: DataFrame, value: str, *lane: str) -> DataFrame:
    """The rows, each with the value of the last of the marks in its lane whose key is not behind its own."""
    kind = marks.schema[value].dataType
    sweep = Window.partitionBy(*lane).orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.withColumn("kind", F.lit(1)).withColumn("mark", F.lit(None).cast(kind)).unionByName(
        marks.select(*lane, "key", F.lit(0).alias("kind"), F.col(value).alias("mark")), allowMissingColumns=True
    )
    swept = both.withColumn(value, F.last("mark", ignorenulls=True).over(sweep))
    return swept.where(F.col("kind") == 1).drop("kind", "mark")


def _in_lanes(marks: DataFrame, lanes: Column) -> DataFrame:
    """The marks once for each lane."""
    return marks.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), lanes.cast("long") - 1)))


def _in_blocks(urls: DataFrame, marks: DataFrame, starts: DataFrame, lanes: int) -> tuple[DataFrame, DataFrame]:
    """URLs and marks with their block, and lanes within it."""
    row_hash = F.xxhash64("id", "host", "path")
    begun = starts.select("key", F.col("key").alias("block"))
    placed = _last_before(urls, _in_lanes(begun, F.lit(lanes)), "block", "lane").withColumn("block", F.coalesce("block", F.lit("")))
    # One row for each block that has URLs: far fewer than there are rules.
    sizes = placed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / LANE_ROWS).alias("lanes"))
    sizes = save(sizes, "url-blocks")
    urls = placed.join(sizes, "block").withColumn("lane", F.pmod(row_hash, F.col("lanes"))).drop("lanes")
    spread = marks.withColumn("lane", F.pmod(F.xxhash64("key"), F.lit(MIN_LANES)))
    marks = _last_before(spread, _in_lanes(begun, F.lit(MIN_LANES)), "block", "lane").drop("lane")
    marks = marks.withColumn("block", F.coalesce("block", F.lit(""))).join(sizes, "block")
    return urls, _in_lanes(marks, F.col("lanes")).drop("lanes")


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """id, host, path, rule (null: none fits) and verdict of every row of `pages`."""
    host, path = url_parts(F.col(url_col))
    lanes = max(MIN_LANES, -(-pages.count() // LANE_ROWS))
    urls = (
        pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
        .withColumn("lane", F.pmod(F.xxhash64("id", "host", "path"), F.lit(lanes)))
        .withColumn("key", _key(_labels(F.col("host"))))
    )
    marks = save(boundaries(rules), "url-boundaries")
    starts = marks.where(F.pmod(F.xxhash64("key"), F.lit(BLOCK_MARKS)) == 0)
    if starts.isEmpty():
        swept = _last_before(urls, _in_lanes(marks, F.lit(lanes)), "stack", "lane")
    else:
        urls, marks = _in_blocks(urls, marks, starts, lanes)
        swept = _last_before(urls, marks, "stack", "block", "lane")
    best = F.array_max(F.filter("stack", lambda rule: F.startswith(F.col("path"), rule["path"])))
    return swept.withColumn("best", best).select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
