"""Operator 5: URL filters by rules and gradient-boosted trees on lexical features.

Longest matching (host, path) rules decide where they apply. Those decisions are the labels from which gradient-boosted
trees learn to judge the other URLs from their spelling alone: length, depth, digit ratio, entropy, parameter counts and
statistics of the host's suffixes over all URLs. The share of a suffix's URLs that are blocked is taken out of fold: a labelled
URL sees only labels of other folds (by hash of the URL). The trees are fitted on at most TRAIN_ROWS labelled URLs, chosen by hash
(documented bound); suffix statistics cover every row. Cases: a null URL or one without "://" has an empty host and path, no
rule and the features of an empty text; repeated rows are judged alike; without both labels every other URL is allowed;
an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
TRAIN_ROWS, TREES, DEPTH, SEED, FOLDS = 20_000, 12, 4, 11, 5
FEATURES = ["length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "query_length", "labels", "longest_label", "hyphens", "top_rows", "top_blocked", "domain_rows", "domain_blocked"]


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host and path of a URL column."""
    rest = F.expr(f"case when {url} is not null and contains({url}, '://') then substring({url}, locate('://', {url}) + 3) else '' end")
    host = F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumn("_rest", rest).withColumns({"host": host, "path": F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)}).drop("_rest")


def with_rule(df: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """df (host, path) with the longest rule that fits (null if none does) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return df.withColumns({"rule": rule, "rule_verdict": verdict})


def _entropy(text: Column) -> Column:
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.length(text)
    share = F.transform(F.array_distinct(chars), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(F.lit(0.0))


def with_features(df: DataFrame) -> DataFrame:
    """df (url, host, path, rule_verdict) with FEATURES; suffix statistics are counted over all rows, pre-aggregated per suffix."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    df = df.withColumns({
        "length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"), "depth": F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit(""))),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)), "entropy": _entropy(url),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "query_length": F.length(query), "labels": F.size(labels),
        "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))), "hyphens": F.length("host") - F.length(F.replace(F.col("host"), F.lit("-"), F.lit(""))),
        "top": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2),
    })
    fold = F.pmod(F.xxhash64(url), F.lit(FOLDS))
    own = F.when(F.col("rule_verdict").isNotNull(), fold)
    for name in ("top", "domain"):
        sums = {"blocked": F.count_if(F.col("rule_verdict") == "block"), "labelled": F.count("rule_verdict")}
        folds = [F.struct(F.count_if((F.col("rule_verdict") == "block") & (fold == i)).alias("blocked"), F.count_if(F.col("rule_verdict").isNotNull() & (fold == i)).alias("labelled")) for i in range(FOLDS)]
        counts = df.groupBy(name).agg(F.log1p(F.count("*")).alias(f"{name}_rows"), F.struct(*[c.alias(k) for k, c in sums.items()]).alias("_all"), F.array(*folds).alias("_folds"))
        left_out = F.get("_folds", own)
        seen = {k: F.col(f"_all.{k}") - F.coalesce(left_out[k], F.lit(0)) for k in sums}
        df = df.join(counts, name).withColumn(f"{name}_blocked", (seen["blocked"] + 1) / (seen["labelled"] + 2)).drop("_all", "_folds")
    return df.drop("top", "domain")


def _features(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    rows = with_rule(with_parts(pages.select("page_id", F.col("url").cast("string").alias("url"))), rules)
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(rows))


def _trees(rows: DataFrame, train_rows: int):
    """Trees fitted on the labelled rows; None without both labels."""
    from pyspark.ml.classification import GBTClassifier

    label = (F.col("rule_verdict") == "block").cast("double").alias("label")
    train = rows.filter("rule_verdict is not null").select("features", label, F.xxhash64("url").alias("at")).orderBy("at", "label").limit(train_rows).select("features", "label")
    train = common.saved(train).coalesce(4)
    if train.select("label").distinct().count() < 2:
        return None
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=SEED).fit(train)


def _score(rows: DataFrame, model) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    if model is None:
        return rows.withColumn("score", F.lit(0.0))
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1])


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' probability of a block, for every row of pages (page_id, url, ...)."""
    rows = _features(pages, rules)
    rows = _score(rows, _trees(rows, train_rows))
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def held_out_accuracy(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, train_rows: int = TRAIN_ROWS) -> tuple[float, float]:
    """Share of labelled URLs of one fold that trees fitted on the others, with statistics of the others, judge as the rules do; share of the commoner label there."""
    rows = with_rule(with_parts(pages.select("page_id", F.col("url").cast("string").alias("url"))), rules).filter("rule_verdict is not null")
    test = F.pmod(F.xxhash64("url", F.lit(1)), F.lit(FOLDS)) == 0
    hidden = rows.withColumn("truth", F.col("rule_verdict")).withColumn("rule_verdict", F.when(~test, F.col("rule_verdict")))
    from pyspark.ml.feature import VectorAssembler

    hidden = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(hidden))
    got = _score(hidden, _trees(hidden, train_rows)).filter("rule_verdict is null")
    right = got.agg(F.avg(((F.col("score") >= 0.5) == (F.col("truth") == "block")).cast("double")), F.avg((F.col("truth") == "block").cast("double"))).first()
    return right[0], max(right[1], 1 - right[1])


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for the URL of every page."""
    return judged(common.table(spark, sf_dir, "pages"))
