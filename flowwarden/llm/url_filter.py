"""URL filters: rules by host and path first, gradient-boosted trees on lexical features for the rest. No Python on the rows."""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.common import stage

RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Distinct labelled urls of either label the trees are fitted on, at most about so many; the statistics of suffixes take all rows.
SAMPLE_ROWS = 20_000
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters",
    "hyphens", "fragment", "section_rows",
)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")), F.lit(""))


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with the rule's."""
    found = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        suffix, _, start = rule.partition("/")
        fits = ((host == suffix) | host.endswith(f".{suffix}")) & path.startswith(f"/{start}")
        found.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*found, F.lit(None).cast("string"))


def with_features(pages: DataFrame) -> DataFrame:
    """host, path and the lexical features of ``url``; a null url has the features of an empty one."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    chars = F.filter(F.split(url, ""), lambda x: x != "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    entropy = F.aggregate(
        F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    return (
        pages.withColumn("rest", _rest(F.col("url")))
        .withColumn("host", host_of(F.col("rest"))).withColumn("path", path_of(F.col("rest")))
        .withColumn("section", F.concat_ws("/", F.substring_index("host", ".", -2), F.regexp_extract("path", "^/([^/]*)", 1)))
        .select(
            "*",
            F.length(url).cast("double").alias("url_length"),
            F.length("host").cast("double").alias("host_length"),
            F.length("path").cast("double").alias("path_length"),
            count(F.col("path"), "/").alias("depth"),
            count(F.col("host"), r"\.").alias("labels"),
            (count(url, "[0-9]") / n).alias("digit_ratio"),
            entropy.alias("entropy"),
            (count(query, "[^&]+")).alias("parameters"),
            count(url, "-").alias("hyphens"),
            F.contains(url, F.lit("#")).cast("double").alias("fragment"),
        )
    )


def with_suffix_statistics(rows: DataFrame) -> DataFrame:
    """``rows`` with the log of how many rows share the last two parts of their host and the first folder.

    No statistic is made from labels: rules are written for suffixes and folders, so the share of blocked urls of one
    would be the label itself, as would rows of a whole suffix, of which there are few.
    """
    counts = rows.groupBy("section").agg(F.log1p(F.count("*")).alias("section_rows"))
    return rows.join(stage(counts, "suffixes"), "section")


def labelled_sample(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Distinct labelled urls, at most about ``sample_rows`` of either label, with the rows each stands for as weight."""
    labelled = rows.where("label is not null")
    share = F.lit(1.0)
    for r in labelled.groupBy("label").agg(F.approx_count_distinct("url").alias("n")).collect():
        share = F.when(F.col("label") == r["label"], min(1.0, sample_rows / max(r["n"], 1))).otherwise(share)
    drawn = labelled.withColumn("share", share).where(F.pmod(F.xxhash64("url"), F.lit(2**30)) < F.col("share") * 2**30)
    # label, share and features are the same for all rows of a url
    return drawn.groupBy("url").agg(
        F.first("label").alias("label"), F.first("features").alias("features"),
        (F.count("*") / F.first("share")).alias("weight")).drop("url")


def judge(pages: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, score.

    The rules label the urls they fit; those labels train the trees, on at most about ``sample_rows`` distinct urls
    of either label, taken by a hash of the url and weighted by the rows they stand for, and the trees judge the urls
    that no rule fits (block from a score of 0.5 on). With
    labels of one kind only that kind is the verdict, without any it is allow. Null and malformed urls have an
    empty host and path and go to the trees; repeated rows get the same verdict.
    """
    rows = with_features(pages.select("page_id", "url"))
    verdict = F.create_map(*[F.lit(x) for pair in rules for x in pair])
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("by_rule", F.when(F.col("rule").isNotNull(), F.element_at(verdict, F.col("rule"))))
    rows = rows.withColumn("label", F.when(F.col("rule").isNotNull(), (F.col("by_rule") == "block").cast("double")))
    rows = stage(rows, "urls")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_suffix_statistics(rows))
    sample = stage(labelled_sample(rows, sample_rows), "labelled")
    found = {r["label"] for r in sample.select("label").distinct().collect()}
    if len(found) < 2:
        only = "block" if 1.0 in found else "allow"
        scored = rows.withColumn("score", F.lit(None).cast("double"))
        own = F.lit(only)
    else:
        model = GBTClassifier(
            featuresCol="features", labelCol="label", weightCol="weight", maxIter=20, maxDepth=4, stepSize=0.2, seed=7, predictionCol="guess",
        ).fit(sample)
        scored = model.transform(rows).withColumn("score", _positive(F.col("probability")))
        own = F.when(F.col("guess") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), "score")


def _positive(probability: Column) -> Column:
    from pyspark.ml.functions import vector_to_array

    return F.element_at(vector_to_array(probability), 2)
