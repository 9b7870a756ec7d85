"""URL filter lists: host-suffix and path-prefix expressions, joined on short hash prefixes.

Every distinct (host, path) is expanded into the expressions that a rule could have: each suffix of
its host by labels, with each prefix of its path that is as long as some rule's path. Expressions
meet rules on the first 32 bits of their SHA-256; the full digests then decide, and the longest rule
wins. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: host, path and verdict of the rules that op10 applies
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
RULE_SCHEMA = "host string, path string, verdict string"


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every page (columns of those names, in whatever case, are replaced).

    A rule fits its host and all subdomains when the path starts with the rule's. The longest rule
    wins; of equally long ones that with the longer host, then block. No rule: ``default``.
    A null url, or one without ``://``, has an empty host and path. Rules with null parts are ignored;
    a rule's host is lower-cased. Empty tables of pages or rules are fine. Repeated rows are judged alike and all
    stay. A very long url is judged whole; a host makes an expression for each of its labels.
    """
    taken = {"host", "path", "rule", "verdict"}
    pages = pages.drop(*[f"`{c}`" if "." in c else c for c in pages.columns if c.lower() in taken])
    judged = pages.withColumns({"host": url_host(pages[url_col]), "path": url_path(pages[url_col])})

    rules = rules.where("host is not null and path is not null and verdict is not null")
    rules = rules.select(F.lower("host").alias("rhost"), F.col("path").alias("rpath"), "verdict")
    rules = rules.withColumn("rule", F.concat("rhost", "rpath")).withColumn("digest", F.sha2("rule", 256))
    # rules that only differ in where host and path part must not meet: the host's length is in the key
    rules = rules.withColumn("hlen", F.length("rhost")).withColumn("prefix", F.substring("digest", 1, 8))
    lengths = rules.select(F.length("rpath").alias("plen")).distinct()
    lengths = lengths.agg(F.sort_array(F.collect_list("plen")).alias("plens"))  # one row, of distinct lengths

    distinct = judged.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wide = distinct.join(F.broadcast(lengths)).select("host", "path", F.explode(suffixes).alias("suffix"), "plens")
    fitting = F.filter("plens", lambda n: n <= F.length("path"))
    wide = wide.select("host", "path", "suffix", F.explode(fitting).alias("plen"))
    keyed = wide.select(
        "host", "path", F.length("suffix").alias("hlen"),
        F.sha2(F.concat("suffix", F.substring(F.col("path"), F.lit(1), F.col("plen"))), 256).alias("digest"),
    ).withColumn("prefix", F.substring("digest", 1, 8))
    # the join sees the short prefix only; what meets by chance fails the comparison of digests here
    met = keyed.join(rules.withColumnRenamed("digest", "whole"), ["prefix", "hlen"])
    rank = F.struct(F.length("rule"), F.col("hlen"), (F.col("verdict") == "block").cast("int"), "rule", "verdict")
    won = met.groupBy("host", "path").agg(F.max(F.when(F.col("digest") == F.col("whole"), rank)).alias("won")).where("won is not null")
    won = won.select("host", "path", F.col("won.rule").alias("rule"), F.col("won.verdict").alias("verdict"))
    # pages without a host, which may be many, stay out of the join
    out = judged.where("host <> ''").join(won, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    return out.unionByName(judged.where("host = ''").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)}))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's url by RULES."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, spark.createDataFrame(RULES, RULE_SCHEMA)).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*(/[^?#]*)', 1, 's') AS path
  FROM pages),
r(rhost, rpath, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT DISTINCT u.host, u.path, r.rhost || r.rpath AS rule, r.v,
         row_number() OVER (PARTITION BY u.host, u.path ORDER BY length(r.rhost || r.rpath) DESC, length(r.rhost) DESC, r.v DESC) AS k
  FROM (SELECT DISTINCT host, path FROM u) u JOIN r
    ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM u LEFT JOIN m ON u.host = m.host AND u.path = m.path AND m.k = 1
"""
