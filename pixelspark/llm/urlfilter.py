"""URL rules by a sort-merge range join, in DataFrame functions alone.

A host is written with its labels reversed (``www.example.com`` as ``com.example.www.``), so a host and all its
subdomains are one interval of keys, and intervals nest or are apart. Urls and rules are sorted together by key. At
each place of that order the stack of rules whose interval is open is what the last rule before it has as its own
prefixes, of which those that aren't prefixes of the url's key have been closed meanwhile. A first sweep finds each
url's open hosts; a second one, over those hosts' keys with the path behind, finds the rule of the longest path.

Each sweep deals rows out by range of (key, kind, row), so that any number of urls of one host is split, and hands
each partition the stack that is open where it begins. Its cost is two sorts of the urls, whatever the rules' number.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, partitions, staged, table

#: The rules of the registered query: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DEFAULT_VERDICT = "allow"
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def _with_stacks(marks: DataFrame) -> DataFrame:
    """``marks`` (key, info; keys differ) with the stack that is open after each: itself and the marks around it,
    outermost first. A mark around it has a prefix of its key, so the stack is no deeper than the key is long."""
    prefixes = marks.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda k: F.substring(F.col("key"), F.lit(1), k))).alias("outer"))
    outer = marks.select(F.col("key").alias("outer"), "info")
    found = prefixes.join(outer, "outer").groupBy("key")
    return found.agg(F.array_sort(F.collect_list(F.struct(F.length("outer").alias("size"), F.col("outer").alias("mark"), "info"))).alias("stack"))


def _sweep(points: DataFrame, marks: DataFrame, name: str) -> DataFrame:
    """``points`` (key, row, more) with ``open``: the stack of marks whose key is a prefix of theirs."""
    more = [x for x in points.columns if x not in ("key", "row")]
    stacks = _with_stacks(marks)
    point_rows = points.select("key", F.lit(1).alias("kind"), "row", F.struct(*more).alias("point"))
    both = point_rows.unionByName(stacks.select("key", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("row"), "stack"), allowMissingColumns=True)
    dealt = staged(both.repartitionByRange(partitions(points.sparkSession), "key", "kind", "row").withColumn("part", F.spark_partition_id()), name)
    ends = dealt.groupBy("part").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("last"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    carried = ends.select("part", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    so_far = Window.partitionBy("part").orderBy("key", "kind", "row").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.join(carried, "part").withColumn("stack", F.coalesce(F.last("stack", ignorenulls=True).over(so_far), "carried"))
    opened = F.filter(F.coalesce("stack", F.array().cast(stacks.schema["stack"].dataType)), lambda x: F.col("key").startswith(x["mark"]))
    return swept.where("kind = 1").select("key", "row", "point.*", opened.alias("open"))


def judge_urls(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """``pages`` with host, path, rule and verdict, one row each.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the url's path starts with the
    rule's; of those that fit, the longest (host and path together, then the host) decides. Of rules with the same
    host and path ``block`` wins; rules without a host or with a null fit nothing. A url that is null or has no
    ``://`` has an empty host and path and no rule. Repeated pages each keep their row. Columns of ``pages`` that
    clash with the four new ones are dropped. No rules, or no pages, are no error.
    """
    new = {"host", "path", "rule", "verdict"}
    keep = [x for x in pages.columns if x.lower() not in new]
    url = F.col(url_col)
    points = pages.select(F.struct(*[F.col(f"`{x}`") for x in keep]).alias("page"), host_of(url).alias("host"), path_of(url).alias("path"))
    points = staged(points.withColumns({"key": host_key(F.col("host")), "row": F.monotonically_increasing_id()}), "url-points")
    rules = rules.where("host IS NOT NULL AND host <> '' AND path IS NOT NULL AND verdict IS NOT NULL")
    rules = rules.withColumn("host", lower_ascii(F.col("host"))).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    keyed = rules.withColumn("hkey", host_key(F.col("host")))
    hosts = keyed.select(F.col("hkey").alias("key")).distinct().withColumn("info", F.lit(""))
    of_rule = F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict")
    marks = keyed.select(F.concat("hkey", "path").alias("key"), of_rule.alias("info"))

    near = _sweep(points, hosts, "url-hosts")
    # One row for each open host of a url; a url without any has a key that no rule is a prefix of.
    near = near.select(F.explode_outer(F.transform("open", lambda x: x["mark"])).alias("hkey"), "row", "page", "host", "path")
    near = near.withColumn("key", F.coalesce(F.concat("hkey", "path"), F.lit(""))).drop("hkey")
    found = _sweep(near, marks, "url-paths").withColumn("best", F.try_element_at(F.transform("open", lambda x: x["info"]), F.lit(-1)))
    chosen = found.groupBy("row").agg(F.first("page").alias("page"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("best").alias("best"))
    return chosen.select("page.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a DataFrame, from literals of the plan."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges all pages; a null url, or one without ``://``, has an empty host and path and no rule."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), judged AS (
  SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS place
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM judged WHERE place = 1
"""
