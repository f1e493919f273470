"""URL filters: nested host and path rules, found by a sort-merge range join.

The host of a rule or an url is written with its labels reversed, a slash and the path
behind it. A rule then fits exactly the keys that begin with its own, which is an interval
of the sorted keys, and the intervals of any two rules are nested or apart. An url has one
key for every parent host of as many labels as some rule has, so subdomains need no rules
of their own.

Rule starts, url keys and rule ends are sorted together over slices of equal size. The
running sum of starts and ends is the height of the stack of open rules, and the top of
the stack is the last rule that opened at this height. A rule that is open across slices is
opened again at the head of each, which are at most as many rules as nest. Among the rules
on top for an url's keys the longest wins, then the one with the longer host.

Everything is DataFrame expressions. No row can make a hot group: slices end inside equal
keys, and the keys of one row meet again by a row number. Keys hold no more of a path than
the longest rule can tell apart, and no more labels than the longest rule has, so very
long urls stay one short key per level.

A null url and one without ``://`` have an empty host and path and match no rule with a
host. Rules with a null host, path or verdict are ignored; of equal rules a block counts.
Repeated rows and null ids are judged row by row; without rules every url gets the default;
an empty table gives no rows. Other columns are ignored, or travel in one struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import table
from quirefold.session import materialize

ALLOW, BLOCK = "allow", "block"
#: (host, path, verdict)
RULES = (
    ("com", "/", ALLOW),
    ("example.com", "/en/", BLOCK),
    ("www.example.com", "/en/", ALLOW),
    ("net", "/es/", BLOCK),
    ("net", "/fr/", BLOCK),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _behind_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(_behind_scheme(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(_behind_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, path: Column) -> Column:
    """Sorts like its bytes; a host holds no slash, so the first one ends it."""
    return F.encode(F.concat(F.array_join(labels, "."), F.lit("/"), path), "utf-8")


def _judged_rules(rules: DataFrame) -> DataFrame:
    """One row per rule, with the interval of its keys: ``_key`` to ``_key`` and a byte no text has."""
    host = F.translate("host", _UPPER, _LOWER)
    return (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
        .groupBy(host.alias("_host"), F.col("path").alias("_path"))
        .agg(F.max("verdict").alias("_verdict"))  # "block" is above "allow"
        .select(
            _key(_labels(F.col("_host")), F.col("_path")).alias("_key"), F.size(_labels(F.col("_host"))).alias("_levels"),
            F.length("_path").alias("_reach"),
            F.struct(
                (F.length("_host") + F.length("_path")).alias("size"), F.length("_host").alias("host_size"),
                F.concat("_host", "_path").alias("rule"), F.col("_verdict").alias("verdict"),
            ).alias("_rule"),
        )
    )


def _url_keys(urls: DataFrame, carried: Column, levels: Sequence[int], reach: int) -> DataFrame:
    """Every url once for each parent host that may have rules; the first of them carries the row."""
    labels = _labels(F.col("_host"))
    fitting = F.filter(F.array(*[F.lit(n) for n in levels]).cast("array<int>"), lambda n: n <= F.col("_n"))
    # a path is only read as far as the longest rule goes
    path = F.substring("_path", 1, reach)
    return (
        urls.select("*", labels.alias("_labels"), F.size(labels).alias("_n"), F.monotonically_increasing_id().alias("_row"))
        .select("*", F.posexplode_outer(fitting).alias("_at", "_level"))
        .select(
            # a host with fewer labels than any rule keeps its row, under a key before all rules
            F.coalesce(_key(F.slice("_labels", F.lit(1), F.col("_level")), path), F.encode(F.lit(""), "utf-8")).alias("_key"),
            F.lit(0).alias("_step"), "_row",
            F.when(F.coalesce(F.col("_at"), F.lit(0)) == 0, carried).alias("_carried"),
        )
    )


def filter_urls(pages: DataFrame, rules: DataFrame, keep: Sequence[str] = ("page_id",), default: str = ALLOW) -> DataFrame:
    """One row per row of ``pages``: ``row`` (struct of ``keep``), host, path, rule, verdict.

    ``rules`` has ``host, path, verdict``; a rule fits its host and all subdomains.
    """
    spark = pages.sparkSession
    judged = materialize(_judged_rules(rules))
    seen = judged.agg(F.sort_array(F.collect_set("_levels")).alias("levels"), F.max("_reach").alias("reach")).first()
    urls = pages.select(F.struct(*[F.col(c) for c in keep]).alias("_kept"), host_of(F.col("url")).alias("_host"), path_of(F.col("url")).alias("_path"))
    carried = F.struct(F.col("_kept").alias("row"), F.col("_host").alias("host"), F.col("_path").alias("path"))
    keys = _url_keys(urls, carried, seen.levels, seen.reach or 0)

    # starts come before urls of the same key, ends behind all keys they are a prefix of
    nothing = F.lit(None)
    starts = judged.select("_key", F.lit(1).alias("_step"), nothing.cast("bigint").alias("_row"), nothing.alias("_carried"), "_rule")
    ends = judged.select(F.concat("_key", F.unhex(F.lit("FF"))).alias("_key"), F.lit(-1).alias("_step"), nothing.cast("bigint").alias("_row"), nothing.alias("_carried"), "_rule")
    points = keys.withColumn("_rule", F.lit(None).cast(judged.schema["_rule"].dataType))
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = materialize(
        points.unionByName(starts).unionByName(ends)
        .repartitionByRange(slices, F.col("_key"), F.desc("_step"), F.col("_row"))
        .withColumn("_slice", F.spark_partition_id())
    )
    # rules that are open where a slice begins
    again = (
        sliced.where("_step <> 0").groupBy("_rule")
        .agg(F.min("_slice").alias("_from"), F.max("_slice").alias("_to"), F.min("_key").alias("_key"))
        .where("_from < _to")
        .select("_key", F.lit(1).alias("_step"), nothing.cast("bigint").alias("_row"), nothing.alias("_carried"), "_rule", F.explode(F.sequence(F.col("_from") + 1, F.col("_to"))).alias("_slice"))
    )
    in_order = [F.col("_key"), F.desc("_step"), F.col("_row")]
    sweep = Window.partitionBy("_slice").orderBy(*in_order).rowsBetween(Window.unboundedPreceding, 0)
    level = Window.partitionBy("_slice", "_height").orderBy(*in_order).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.last(F.when(F.col("_step") == 1, F.col("_rule")), ignorenulls=True).over(level)
    met = (
        sliced.unionByName(again)
        .withColumn("_height", F.sum("_step").over(sweep))
        .withColumn("_top", F.when(F.col("_height") > 0, opened))
        .where(F.col("_row").isNotNull())
    )
    best = met.where(F.col("_carried").isNotNull() | F.col("_top").isNotNull()).groupBy("_row").agg(
        F.max("_top").alias("_top"), F.first("_carried", ignorenulls=True).alias("_carried")
    )
    return best.select("_carried.*", "_top.rule", F.coalesce("_top.verdict", F.lit(default)).alias("verdict"))


def op13_urlfilter(spark, sf_dir) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules).select("row.page_id", "host", "path", "rule", "verdict")


OP13_SQL = f"""
with rules(host, path, verdict) as (values {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
parted as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
named as (
  select row_number() over () as n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parted),
judged as (
  select n, arg_max(r.host || r.path, length(r.host || r.path) * 1000 + length(r.host)) as rule,
         arg_max(r.verdict, length(r.host || r.path) * 1000 + length(r.host)) as verdict
  from named p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
  group by n)
select page_id, host, path, rule, coalesce(verdict, '{ALLOW}') as verdict from named left join judged using (n)
"""
