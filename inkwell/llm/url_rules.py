"""URL filters as a sort-merge range join of reversed-host keys with nested rule intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions.ascii import ascii_lower
from inkwell.operators.skew import join_groups
from inkwell.storage import materialize

#: (host, path, verdict) of the production query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DEFAULT = "allow"
#: Ends the host part of a key.
_END = "\u0001"


def parts(url):
    """(host, path) columns: what follows the first :// up to / ? or #, A-Z lower-cased; then up to ? or #."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _nested(rules: DataFrame) -> DataFrame:
    """(key, stack): each rule's key with the rules, itself last, whose keys are prefixes of it."""
    key = F.concat(F.concat_ws(".", F.reverse(F.split("host", "\\."))), F.lit(_END), F.col("path"))
    rule = F.struct(key.alias("key"), F.concat("host", "path").alias("rule"), "verdict")
    keyed = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(key.alias("key"), rule.alias("rule"))
    outer = keyed.select(F.col("key").alias("outer_key"), F.col("rule").alias("outer"))
    heads = keyed.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring("key", F.lit(1), n))).alias("outer_key"))
    return heads.join(outer, "outer_key").groupBy("key").agg(F.array_sort(F.collect_list("outer")).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """(id, host, path, rule, verdict) of every row by the longest rule (host, path, verdict) that fits its url.

    A rule fits its host and all subdomains if the url's path starts with the rule's. A url is looked up under
    a key for each suffix of its host that has no more labels than some rule: the suffix reversed by labels,
    then the path. A rule then covers the interval of keys that start with its own, and intervals nest or are
    disjoint: keys and rules are sorted together in ranges, each key sees the stack of rules nested about the
    last rule before it (carried from earlier ranges), and takes the innermost that still covers it.
    Among rules of one length the longer host wins; equal rules with two verdicts count as the larger (block).
    A null url or one without :// has empty host and path, no rule and the default verdict, like any url that
    no rule fits. Repeated urls are looked up once and joined back in spread parts; an empty table of pages
    gives an empty one, and one of rules leaves the default. Extra columns are not read.
    """
    spark = pages.sparkSession
    host, path = parts(F.col(url_col))
    urls = materialize(pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")), "urls")
    places = urls.groupBy("host", "path").agg(F.count("*").alias("n_rows"))
    nested = materialize(_nested(rules), "rules")
    deepest = rules.agg(F.max(F.size(F.split("host", "\\.")))).first()[0] or 0
    labels = F.reverse(F.split("host", "\\."))
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))), lambda n: F.concat_ws(".", F.slice(labels, F.lit(1), n))))
    keys = places.where((F.col("host") != "") & F.lit(deepest > 0)).select("host", "path", suffix.alias("suffix"))
    keys = keys.select(F.concat("suffix", F.lit(_END), "path").alias("key"), "host", "path")
    none = F.lit(None)
    events = keys.withColumn("stack", none.cast(dict(nested.dtypes)["stack"])).unionByName(nested.select("key", none.cast("string").alias("host"), none.cast("string").alias("path"), "stack"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = events.repartitionByRange(ranges, F.col("key"), F.col("host").asc_nulls_first()).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")  # a range is what was dealt, also after a lost task
    sweep = Window.partitionBy("part").orderBy("key", F.col("host").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    local = F.last("stack", ignorenulls=True).over(sweep)
    ends = ranged.groupBy("part").agg(F.max_by("stack", F.when(F.col("stack").isNotNull(), F.col("key"))).alias("stack"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", F.last("stack", ignorenulls=True).over(before).alias("carried"))  # a row for each range
    swept = ranged.withColumn("local", local).where(F.col("host").isNotNull()).join(F.broadcast(carried), "part", "left")
    active = F.filter(F.coalesce("local", "carried"), lambda r: F.startswith("key", r["key"]))
    found = swept.select("host", "path", F.try_element_at(active, F.lit(-1)).alias("r")).where("r is not null")
    rank = F.struct(F.length("r.rule").alias("a"), F.length("r.key").alias("b"), F.length(F.substring_index("r.key", _END, 1)).alias("c"), F.col("r.key").alias("d"), F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))
    best = found.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", "best.rule", "best.verdict")
    judged = places.join(best, ["host", "path"], "left")
    out = join_groups(urls, materialize(judged, "judged"), ["host", "path"], "n_rows", "id")
    return out.select("id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules).withColumnRenamed("id", "page_id")


OP5_SQL = """
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, arg_max(h || rules.p, length(h || rules.p)) AS rule, arg_max(verdict, length(h || rules.p)) AS verdict
      FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p) GROUP BY page_id)
SELECT p.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
