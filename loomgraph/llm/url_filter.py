"""URL filters (operator 1).

Listed canonical URLs and rules are keys in a blocked Bloom filter. The keys that a
URL could match are probed there; possible hits go to an exact hash join that
removes the false positives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bloom
from loomgraph.llm.common import lower_az, maybe_broadcast, read


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z lower-cased; else empty."""
    return lower_az(F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """From the host's end to the next ``?``, ``#`` or end; else empty."""
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to pages.

    ``rules`` (host, path, verdict): a rule fits its host and all subdomains if the
    URL's path starts with the rule's; the longest (host and path, then host) wins.
    ``listed`` (url): where no rule fits, URLs whose canonical form (host and path)
    is listed are blocked, all others allowed.

    Null URLs and those without ``://`` have an empty host and path and fit no rule.
    Repeated rows each get a verdict; empty tables give no rows; equal rules with
    different verdicts block. Other columns of pages are kept; those named host,
    path, rule or verdict are replaced.
    """
    rules = rules.select(F.col("host").alias("_rh"), F.col("path").alias("_rp"), "verdict").where("_rh is not null and _rp is not null and _rh != ''")
    rules = rules.groupBy("_rh", "_rp").agg(F.max("verdict").alias("_verdict")).withColumn("_key", F.concat(F.lit("r"), F.col("_rh"), F.lit("\n"), F.col("_rp")))
    at = F.struct(host_of(F.col("url")), path_of(F.col("url")))
    exact = listed.select(at.alias("at")).where("at.col1 != ''").select(F.concat(F.lit("u"), F.col("at.col1"), F.lit("\n"), F.col("at.col2")).alias("_key")).distinct()
    rules = rules.select("_key", "_rh", "_rp", "_verdict")
    exact = exact.select("_key", F.lit(None).cast("string").alias("_rh"), F.lit(None).cast("string").alias("_rp"), F.lit("block").alias("_verdict"))
    # the lengths of rule paths: at most a few hundred numbers, however many rules there are
    lengths = F.array(*[F.lit(r.n) for r in rules.select(F.length("_rp").alias("n")).distinct().collect()]).cast("array<int>")

    # other columns of pages are in a struct meanwhile, so that they may have any names
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parted = pages.select(F.struct(*[pages[c].alias(f"c{i}") for i, c in enumerate(own)]).alias("row"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    places = parted.select("host", "path").where("host != ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    of_rules = F.flatten(F.transform(suffixes, lambda h: F.transform(starts, lambda p: F.concat(F.lit("r"), h, F.lit("\n"), p))))
    of_url = F.concat(F.lit("u"), F.col("host"), F.lit("\n"), F.col("path"))

    def hits(probes: DataFrame, keys: DataFrame) -> DataFrame:
        """Possible hits of the filter, joined with the keys; rules and URLs apart, since a rule's key is that of many URLs."""
        table, blocks = bloom.build(keys, "_key")
        return bloom.possible(probes, F.col("_key"), table, blocks).join(maybe_broadcast(keys), "_key")

    found = hits(places.select("host", "path", F.explode(of_rules).alias("_key")), rules).unionByName(hits(places.select("host", "path", of_url.alias("_key")), exact))
    rank = F.struct(F.col("_rh").isNotNull().alias("is_rule"), F.coalesce(F.length("_rh") + F.length("_rp"), F.lit(0)).alias("n"), F.coalesce(F.length("_rh"), F.lit(0)).alias("h"))
    best = found.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("_rh", "_rp").alias("rule"), F.col("_verdict").alias("verdict")), rank).alias("best"))
    # pages without a host, however many, fit nothing and are not joined
    out = parted.where("host != ''").join(best, ["host", "path"], "left").unionByName(parted.where("host = ''").withColumn("best", F.lit(None).cast(best.schema["best"].dataType)))
    return out.select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(own)],
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
    )


def rules_frame(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages under the rules; listed are the URLs whose page has no html."""
    pages = read(spark, sf_dir, "pages")
    listed = pages.where("coalesce(html, '') = ''").select("url")
    return judge(pages.select("page_id", "url"), rules_frame(spark), listed).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), q AS (SELECT page_id, html, coalesce(host, '') AS host, coalesce(path, '') AS path FROM s),
rules(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
listed AS (SELECT DISTINCT host, path FROM q WHERE coalesce(html, '') = '' AND host <> ''),
best AS (
  SELECT page_id, max_by(struct_pack(rule := rh || rp, verdict := verdict), length(rh) * 1000 + length(rp) * 1001) AS b
  FROM q JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT q.page_id, q.host, q.path, b.rule AS rule,
       CASE WHEN b IS NOT NULL THEN b.verdict WHEN listed.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM q LEFT JOIN best USING (page_id) LEFT JOIN listed ON q.host = listed.host AND q.path = listed.path
"""
