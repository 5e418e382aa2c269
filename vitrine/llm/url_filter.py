"""URL filters: host-suffix / path-prefix expressions, hash-prefix join.

Every distinct URL is expanded into expressions ``suffix + prefix`` (each
suffix of its host at a dot with as many dots as some rule's host, each prefix
of its path whose length occurs in the rules, so the longest host or path costs
no more than the rules have lengths). The expressions meet the rules in an equi-join on the first four
bytes of their SHA-256; the full digest and the text itself then confirm the
hit, and the longest fitting rule decides. DataFrame functions only.

The join's sides are left to the planner: small rule lists are broadcast by
their known size, larger ones are shuffled on the hash prefix (both sides have
random keys there, so no key is hot). Work is per distinct URL: a URL held by
a third of all pages is expanded once, and the last join back to the pages is
a left join that AQE can split.

Defined results: null URL, or no ``://``: empty host and path, no rule, the
default verdict. Two rules of one length that both fit: the longer host wins,
then the lexically smaller action. Repeated pages repeat their row. An empty
rule table gives every page the default verdict.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: (host, path prefix, action).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: str) -> Column:
    """How many labels a host has: its dots and one."""
    return F.length(host) - F.length(F.replace(F.col(host), F.lit("."))) + 1


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``."""
    urls = (pages.select(F.col("url")).distinct()
            .select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    rules = (rules.select("host", "path", "action").na.drop().filter("length(host) > 0").distinct()
             .withColumn("expression", F.concat("host", "path"))
             .withColumn("digest", F.sha2("expression", 256)))
    # The lengths that occur in the rules (at most the longest rule has characters).
    lengths = rules.agg(F.array_sort(F.collect_set(F.length("path"))).alias("lengths")).scalar()
    # Numbers of labels, likewise. A suffix of n labels ends the host; a host of fewer labels has none.
    counts = rules.agg(F.array_sort(F.collect_set(_labels("host"))).alias("counts")).scalar()
    expanded = (urls.filter("length(host) > 0").withColumn("lengths", lengths).withColumn("counts", counts)
                .withColumn("n_labels", F.explode(F.filter("counts", lambda n: n <= _labels("host"))))
                .withColumn("suffix", F.expr("substring_index(host, '.', -n_labels)"))
                .withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))))
                .withColumn("prefix", F.substring("path", F.lit(1), F.col("n")))
                .withColumn("expression", F.concat("suffix", "prefix"))
                .withColumn("digest", F.sha2("expression", 256)))
    short = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    left = expanded.select("url", "suffix", "prefix", "digest", short.alias("short"))
    right = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "action",
                         F.col("digest").alias("r_digest"), short.alias("r_short"))
    hit = (left.join(right, F.col("short") == F.col("r_short"))
           .filter((F.col("digest") == F.col("r_digest")) & (F.col("suffix") == F.col("r_host"))
                   & (F.col("prefix") == F.col("r_path"))))
    # Largest struct: longest rule, then longer host, then the smaller action ("allow" before "block").
    best = hit.groupBy("url").agg(F.max(F.struct(
        (F.length("r_host") + F.length("r_path")).alias("length"), F.length("r_host").alias("of_host"),
        (F.col("action") == "allow").alias("allows"),
        F.concat("r_host", "r_path").alias("rule"), F.col("action"))).alias("best"))
    known = best.select(F.col("url").alias("hit_url"), "best.rule", F.col("best.action").alias("action"))
    rows = pages.select("page_id", "url")
    return (rows.join(known, rows.url == known.hit_url, "left")
            .select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                    "rule", F.coalesce("action", F.lit(default)).alias("verdict")))


def contract_rules(spark) -> DataFrame:
    rows = ", ".join("('%s', '%s', '%s')" % rule for rule in RULES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rules(host, path, action)")


def query(spark, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL under the fixed rules; URLs that no rule fits are allowed."""
    from vitrine.llm.common import read
    return judge(read(spark, sf_dir, "pages"), contract_rules(spark))


SQL = r"""
WITH rules(r_host, r_path, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (SELECT row_number() OVER () AS n, page_id,
  translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
fit AS (SELECT n, arg_max(struct_pack(rule := r_host || r_path, action := action),
                          length(r_host || r_path) * 10000 + length(r_host)) AS best
  FROM p JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY n)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict
FROM p LEFT JOIN fit USING (n)
"""
