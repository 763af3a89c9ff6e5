"""URL filter: given rules by host and path first, then association rules mined by FP-growth from labelled URLs."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.session import materialize

# The given rules as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# Of the labelled URLs, a combination needs this share, and a rule this part of its combination's URLs with the label.
SUPPORT = 0.005
CONFIDENCE = 0.5
LABEL = "label=block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lowered; empty for NULL or without '://'."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest given rule that fits, else NULLs."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, of_host, of_path in sorted(RULES, key=lambda r: len(r[1] + r[2])):  # later ones are longer and go over earlier ones
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(of_path)
        rule = F.when(fits, of_host + of_path).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """Different tokens: scheme, host labels, path words with their depth, names in the query, and whether there is a fragment."""
    text = F.coalesce(url, F.lit(""))
    scheme = F.regexp_extract(text, r"(?s)^(.*?)://", 1)
    labels = F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.split(path_of(url), "/"), lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), F.lower(x)))
    query = F.split(F.regexp_extract(text, r"(?s)^[^?#]*\?([^#]*)", 1), "&")
    names = F.transform(query, lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    fragment = F.when(F.contains(text, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    everything = F.concat(F.array(F.concat(F.lit("s:"), F.lower(scheme))), labels, words, names, fragment)
    return F.array_distinct(F.filter(everything, lambda x: ~x.rlike(r"^[a-z0-9]+:$")))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """antecedent, confidence, support of the rules for blocking. `labelled` has url and block (0 or 1).

    A combination with a NULL or empty URL has no tokens and is left out.
    """
    baskets = labelled.where(F.col("url").isNotNull() & F.col("block").isNotNull()).select(
        F.concat(tokens_of(F.col("url")), F.when(F.col("block") == 1, F.array(F.lit(LABEL))).otherwise(F.array().cast("array<string>"))).alias("items")
    )
    baskets = materialize(baskets.where(F.size("items") > 0))
    if baskets.isEmpty():
        return labelled.sparkSession.createDataFrame([], "antecedent array<string>, confidence double, support double")
    rules = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).associationRules
    return rules.where(F.col("consequent") == F.array(F.lit(LABEL))).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")


def mined_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, mined_rule, confidence for URLs that hold all tokens of a rule; the surest rule, then the widest, then the first.

    The inverted index has each rule under its rarest token only (by the rules' own counts), so common tokens draw no rules.
    """
    rules = rules.withColumn("rule", F.array_join("antecedent", " & "))
    spread = rules.select("rule", F.explode("antecedent").alias("token"))
    often = spread.groupBy("token").agg(F.count("*").alias("n"))
    entry = spread.join(often, "token").groupBy("rule").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    index = rules.join(entry, "rule").select("token", "rule", "antecedent", "confidence", "support")
    held = urls.select("url", tokens_of(F.col("url")).alias("tokens"))
    hits = held.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    hits = hits.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.col("rule").alias("mined_rule")))
    return hits.groupBy("url").agg(best.alias("best")).select("url", "best.mined_rule", (-F.col("best.c")).alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence: one row per page.

    `labels` has doc_id (the page's), quality and toxic: low quality or toxic is a reason to block. A given rule decides; else a mined rule
    for blocking; else the page is allowed. NULL URLs have empty host and path, no rule, and are allowed. Repeated rows stay,
    a NULL page_id too (it has no label). More than one label: any reason counts. Other columns are not read.
    """
    rows = pages.select("page_id", F.col("url").cast("string"))
    marks = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("block"))
    labelled = rows.join(marks, rows.page_id == marks.doc_id).select("url", "block")
    mined = mined_verdicts(rows.select("url").where("url is not null").distinct(), materialize(mine(labelled)))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    told = rows.withColumns({"host": host, "path": path}).join(mined, "url", "left")
    rule, verdict = given_rule(F.col("host"), F.col("path"))
    return told.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "mined_rule",
        "confidence",
    )
