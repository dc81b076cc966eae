"""URL filters: given rules, and association rules that FP-growth mines from labelled urls.

A url is a set of tokens. FP-growth finds the token sets that go with a label often enough and surely enough; a
url is blocked when all tokens of such a rule are in it, which an inverted index from tokens to rules finds.
Tokens that stand in exactly the same labelled urls are one item, which a url has if it has any of them: as items of
their own they would double the itemsets each, and every rule with one of them would be as good with another.
Given rules of host and path come first, the longest that fits.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, small_side, written

#: A mined rule needs this share of the labelled urls, so many of them, and this share of block labels.
MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE = 0.001, 8, 0.8
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
_BLOCK = "=block"


def host(url: Column) -> Column:
    """What stands from the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        at = text.index("/")
        fits = ((F.col("host") == text[:at]) | F.col("host").endswith("." + text[:at])) & F.col("path").startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens: labels of the host and the parts of those with a hyphen, segments of the path and keys of the query."""
    labels = F.split(host(url), r"\.")
    parts = F.flatten(F.transform(F.filter(labels, lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, "-")))
    segments = F.split(ascii_lower(path(url)), "[/.]")
    keys = F.regexp_extract_all(url, F.lit("[?&]([^=&#]+)"), 1)
    tag = lambda mark, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    return F.array_distinct(F.concat(tag("host ", labels), tag("part ", parts), tag("path ", segments), tag("query ", F.coalesce(keys, F.array().cast("array<string>")))))


def items(rows: DataFrame, least: int, n: int) -> DataFrame:
    """token and item (the first token that stands in the same rows) of rows (row, token), n of them.

    Tokens of fewer than `least` rows are in no rule, and those of all rows say nothing about a label: both are left
    out. So there are at most as many as the tokens of all rows by `least`.
    """
    counted = rows.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit("second"), "row").cast("decimal(38,0)")).alias("b"))
    counted = written(counted.where((F.col("n") >= least) & (F.col("n") < n)), "url-items")
    return counted.join(counted.groupBy("n", "a", "b").agg(F.min("token").alias("item")), ["n", "a", "b"]).select("token", "item")


def mine(labelled: DataFrame) -> DataFrame:
    """Rules (rule, antecedent, any_of, confidence, support) from urls labelled with block true or false; null ones are left out.

    antecedent holds items, each named by one token; any_of has the tokens of each item in the same place, any of
    which will do. Antecedents have any number of items; a rule that contains a shorter one is left out, as the
    shorter one matches all of its urls.
    """
    spark = labelled.sparkSession
    rows = written(labelled.where("url is not null and block is not null").select(F.expr("uuid()").alias("row"), F.col("block"), tokens(F.col("url")).alias("tokens")), "url-tokens")
    n = rows.count()
    least = max(MIN_ROWS, int(-(-MIN_SUPPORT * n // 1)))
    nothing = spark.createDataFrame([], "rule long, antecedent array<string>, any_of array<array<string>>, confidence double, support double")
    if n < MIN_ROWS:
        return nothing
    each = rows.select("row", F.explode("tokens").alias("token"))
    known = written(items(each, least, n), "url-token-items")
    sets = each.join(small_side(known), "token").groupBy("row").agg(F.collect_set("item").alias("items"))
    baskets = rows.where("block").select("row", F.array(F.lit(_BLOCK)).alias("label")).join(sets, "row", "full").select(F.concat(F.coalesce("items", F.array()), F.coalesce("label", F.array())).alias("items"))
    # Confidence needs the rows of the antecedent, which are there; lift needs the share of blocked urls among all rows.
    lone = rows.where("not block").join(sets, "row", "left_anti").select(F.array().cast("array<string>").alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=least / n * (1 - 1e-9), minConfidence=MIN_CONFIDENCE).fit(written(baskets.unionByName(lone), "url-baskets")).associationRules
    kept = found.where(F.array_contains("consequent", _BLOCK) & (F.col("lift") > 1))
    kept = minimal(written(kept.select(F.xxhash64(F.array_sort("antecedent")).alias("rule"), F.array_sort("antecedent").alias("antecedent"), "confidence", "support"), "url-rules"))
    members = known.groupBy("item").agg(F.sort_array(F.collect_list("token")).alias("members"))  # tokens of one url
    each = kept.select("rule", F.posexplode("antecedent").alias("at", "item")).join(members, "item")
    any_of = each.groupBy("rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "members"))), lambda x: x.members).alias("any_of"))
    return kept.join(any_of, "rule").select(*nothing.columns)


def minimal(rules: DataFrame) -> DataFrame:
    """rules without those whose tokens include all tokens of a shorter one."""
    index = rules.select(F.col("rule").alias("inner"), F.size("antecedent").alias("size"), F.explode("antecedent").alias("token"))
    each = rules.select("rule", F.size("antecedent").alias("of"), F.explode("antecedent").alias("token"))
    within = each.join(small_side(index), "token").where("size < of").groupBy("rule", "inner", "size").agg(F.count("*").alias("n")).where("n = size")
    return written(rules.join(within.select("rule").distinct(), "rule", "left_anti"), "minimal-url-rules")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule) of each rule of which the url has a token of every item; urls: distinct url."""
    index = rules.select("rule", F.size("any_of").alias("size"), F.posexplode("any_of").alias("at", "members")).select("rule", "size", "at", F.explode("members").alias("token"))
    each = urls.select("url", F.explode(tokens(F.col("url"))).alias("token"))
    hits = each.join(small_side(index), "token").select("url", "rule", "size", "at").distinct()
    return hits.groupBy("url", "rule", "size").agg(F.count("*").alias("n")).where("n = size").select("url", "rule")


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages.

    A null url, or one without ://, has an empty host and path; no given rule fits it, and it is allowed. A url
    that no given rule fits is blocked if a mined rule matches it, else allowed. Repeated rows give repeated
    results; an empty table gives none. Only page_id and url are looked at.
    """
    urls = pages.where("url is not null").select("url").distinct()
    bad = matched(urls, mine(labelled)).select(F.col("url").alias("bad")).distinct()
    rows = pages.select("page_id", "url")
    rows = rows.join(bad, rows["url"] == bad["bad"], "left").select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "bad")
    rule, verdict = given_rule(rules)
    mined = F.when(F.col("bad").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"))


def labels_of_pages(spark: SparkSession, pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, block) of the pages whose document is labelled: a url's path names its document; block: quality 0."""
    of = pages.select("url", F.expr("try_cast(regexp_extract(url, '://[^/?#]*/[^/?#]*/([0-9]+)', 1) as bigint)").alias("doc"))
    known = labels.select(F.col("doc_id").alias("labelled"), (F.col("quality") == 0).alias("block"))
    return of.join(known, of["doc"] == known["labelled"]).select("url", "block")
