"""URL filters: given rules by host and path, and association rules mined from labels.

A given rule fits its host and all hosts below it if the path starts with the rule's; the longest wins (by host, then
path). URLs that no given rule fits are judged by mined rules: FP-growth finds token combinations of labelled URLs
that are bad in ``confidence`` of at least ``support`` of them, and a URL with all tokens of such a rule is blocked.

Tokens are all host labels, all path segments and all parameter names of a URL, each with its runs of digits written as 0,
so that page numbers fall together and no segment is lost. Rules are those that no shorter rule is part of, of any
length; the support bounds their number. A mined rule is entered in an inverted index under its rarest token, so a URL
meets only the rules of the tokens that it has, and a token that half of all URLs share brings no rules with it. Distinct
token lists are matched once.

Edge cases: a null url, or one without "://", has empty host and path and no tokens, so no rule and verdict allow. An
empty table, no labels or no bad label give no mined rules. Repeated rows are judged alike, labels that disagree count
as bad if any is. Other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "=bad"


@dataclass(frozen=True)
class Given:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


GIVEN = (Given("block", "net", "/"), Given("allow", "example.net", "/en/"), Given("block", "example.com", "/de/"), Given("allow", "org", "/fr/"))


def behind(url: Column) -> Column:
    """What follows the first "://"; null without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(behind(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(behind(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, given: tuple[Given, ...]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for g in sorted(given, key=lambda g: (len(g.host), len(g.path), g.name)):
        fits = ((host == g.host) | host.endswith("." + g.host)) & path.startswith(g.path)
        name, verdict = F.when(fits, g.name).otherwise(name), F.when(fits, g.verdict).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens: host labels, path segments and parameter names, runs of digits as 0."""
    query = F.regexp_extract(behind(url), "^[^?#]*\\?([^#]*)", 1)
    params = F.transform(F.split(query, "&"), lambda p: F.regexp_extract(p, "^[^=]*", 0))
    def mark(sign: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda s: s != ""), lambda s: F.concat(F.lit(sign), F.regexp_replace(s, "[0-9]+", "0")))

    every = F.concat(mark("h:", F.split(host_of(url), "\\.")), mark("p:", F.split(path_of(url), "/")), mark("q:", params))
    return F.coalesce(F.array_sort(F.array_distinct(every)), F.array().cast("array<string>"))


def mined_rules(labelled: DataFrame, support: float, confidence: float) -> DataFrame:
    """(tokens, anchor): token lists that are bad, none part of another, staged; ``labelled`` has (url, bad). All labelled
    rows are mined."""
    spark = labelled.sparkSession
    none = spark.createDataFrame([], "tokens array<string>, anchor string")
    rows = labelled.where("bad IS NOT NULL").select(tokens_of(F.col("url")).alias("tokens"), "bad")
    rows = rows.where(F.size("tokens") > 0).select("tokens", F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    if rows.where(F.array_contains("items", BAD)).isEmpty():
        return none
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(rows.select("items"))
    rules = model.associationRules.where(F.array_contains("consequent", BAD)).select(F.array_sort("antecedent").alias("tokens"))
    often = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    each = rules.select("tokens", F.explode("tokens").alias("token")).join(often, "token")
    each = each.groupBy("tokens").agg(F.min(F.struct("n", "token")).alias("rare")).select("tokens", F.col("rare.token").alias("anchor"))
    each = staged(each, "url-rules")
    return staged(each.join(bad_token_lists(each.select("tokens"), each, proper=True), "tokens", "left_anti"), "url-rules")


def bad_token_lists(lists: DataFrame, rules: DataFrame, proper: bool = False) -> DataFrame:
    """The distinct token lists that some rule is part of; ``proper``: some other, shorter rule."""
    index = rules.select(F.col("tokens").alias("rule_tokens"), "anchor")
    met = lists.select("tokens", F.explode("tokens").alias("anchor")).join(index, "anchor")
    met = met.where(F.size("rule_tokens") < F.size("tokens")) if proper else met
    return met.where(F.size(F.array_except("rule_tokens", "tokens")) == 0).select("tokens").distinct()


def judge(
    pages: DataFrame, labelled: DataFrame, given: tuple[Given, ...] = GIVEN, support: float = 0.005, confidence: float = 0.8,
) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule and verdict (allow or block)."""
    url = F.col("url")
    name, verdict = given_rule(F.col("host"), F.col("path"), given)
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens"))
    rows = rows.withColumn("rule", name).withColumn("verdict", verdict)
    lists = rows.where("rule IS NULL").select("tokens").distinct()
    # Staged: few lists are bad, and a join with a written table can split the rows of a very common list.
    bad = staged(bad_token_lists(lists, mined_rules(labelled, support, confidence)), "url-lists").withColumn("bad", F.lit(True))
    out = rows.join(bad, "tokens", "left")
    mined = F.when(F.col("bad"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", mined).alias("verdict"))
