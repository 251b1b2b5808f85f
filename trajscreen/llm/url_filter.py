"""URL filter: rules first, then gradient-boosted trees on lexical features (DataFrame and spark.ml only).

The URLs that a rule fits are the labelled ones; trees learn from a bounded sample of them and judge the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, saved
from .sharding import hashed_52

#: (verdict, host, path) of the registered query's rules, fixed values.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Rows of the training sample at most: the labelled URLs of the lowest key hashes.
SAMPLE = 20_000
FOLDS = 5  # of the labelled rows, for the blocked shares
TREES = {"maxIter": 12, "maxDepth": 4, "maxBins": 32, "stepSize": 0.3, "seed": 7}

FEATURES = ("length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "host_digits", "hyphens", "entropy", "parameters", "fragment", "secure", "last_number", "suffix_share", "suffix_blocked", "section_share", "section_blocked")


def parts(url: Column) -> Column:
    """struct(host, path); both empty for null and where '://' is missing. host: A-Z lower-cased."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    found = F.struct(ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)).alias("host"), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))
    return F.when(url.isNull() | (at == 0), F.struct(F.lit("").alias("host"), F.lit("").alias("path"))).otherwise(found)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (host and path together) that fits the host or a parent domain and
    begins the path; null fields if none does. Of equally long ones the first."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _count(text: Column, symbol: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, symbol, ""))).cast("double")


def lexical(rows: DataFrame) -> DataFrame:
    """rows (url, host, path, ..) with the features that a URL alone gives, and its suffix and first path section."""
    url = F.coalesce(F.col("url"), F.lit(""))
    low = ascii_lower(url)
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    shares = F.transform(F.array_distinct(F.split(low, "")), lambda c: (F.length(low) - F.length(F.replace(low, c, F.lit("")))) / n)
    entropy = F.aggregate(F.filter(shares, lambda s: s > 0), F.lit(0.0), lambda t, s: t - s * F.log2(s))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    added = {
        "length": n, "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"), "host_depth": _count(F.col("host"), "."), "path_depth": _count(F.col("path"), "/"),
        "digit_ratio": _count(url, "0123456789") / n, "host_digits": _count(F.col("host"), "0123456789"), "hyphens": _count(F.col("host"), "-"), "entropy": entropy,
        "parameters": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1), "fragment": F.contains(url, F.lit("#")).cast("double"), "secure": F.startswith(low, F.lit("https:")).cast("double"),
        "last_number": F.coalesce(F.expr("try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS double)"), F.lit(-1.0)),
        "suffix": F.substring_index("host", ".", -1), "section": F.coalesce(F.get(F.split("path", "/"), F.lit(1)), F.lit("")),
    }
    return rows.withColumns(added)


def _with_rates(rows: DataFrame, by: str) -> DataFrame:
    """Share of all rows, and smoothed share of blocked rows among the labelled ones. A labelled row's share leaves out its
    own fold, so that the share doesn't give its label away."""
    total = rows.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("t")).scalar()
    fold = F.pmod(hashed_52(F.col("url"), F.lit("fold")), F.lit(FOLDS)).cast("int")
    folded = rows.withColumn("__fold", F.when(F.col("label").isNotNull(), fold).otherwise(-1))
    sums = saved(folded.groupBy(by, "__fold").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocked")), f"url-{by}")
    every = sums.groupBy(by).agg(F.sum("n").alias("__n"), F.sum("labelled").alias("__labelled"), F.sum("blocked").alias("__blocked"))
    own = sums.where("__fold >= 0").select(by, "__fold", F.col("labelled").alias("__own"), F.col("blocked").alias("__own_blocked"))
    joined = folded.join(every, by).join(own, [by, "__fold"], "left").fillna(0, ["__own"]).fillna(0.0, ["__own_blocked"]).withColumn("__t", total)
    added = {f"{by}_share": F.col("__n") / F.col("__t"), f"{by}_blocked": (F.col("__blocked") - F.col("__own_blocked") + 1.0) / (F.col("__labelled") - F.col("__own") + 2.0)}
    return joined.withColumns(added).drop("__fold", "__n", "__labelled", "__blocked", "__own", "__own_blocked", "__t")


def features(rows: DataFrame) -> DataFrame:
    """rows (key, url, host, path, label: 1 blocked, 0 allowed, null) with every one of FEATURES."""
    out = _with_rates(_with_rates(lexical(rows), "suffix"), "section")
    return out.select(*rows.columns, *FEATURES)


def fit(labelled: DataFrame, key: str, sample: int = SAMPLE) -> GBTClassificationModel | None:
    """Trees from at most `sample` labelled rows; None if they hold fewer than two classes."""
    chosen = saved(labelled.withColumn("__h", hashed_52(F.col(key), F.col("url"))).orderBy("__h", key).limit(sample).drop("__h"), "url-sample")
    if chosen.select("label").distinct().count() < 2:
        return None
    ordered = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(chosen).select(key, "label", "features").coalesce(1).sortWithinPartitions(key)
    return GBTClassifier(featuresCol="features", labelCol="label", **TREES).fit(ordered)


def judged(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """One row per row of pages: key, host, path, rule, verdict, score (probability of block; null where a rule fits).

    The rule's verdict holds where one fits; else block if the trees' probability is over one half. Null and odd URLs
    have an empty host and path and are judged like others, very long ones whole. Without labelled rows of both verdicts all the rest are
    allowed (score 0). Repeated rows get equal results. An empty table gives no rows. Other columns aren't read.
    """
    rows = pages.select(F.col(key), F.col(url).alias("url")).withColumn("__p", parts(F.col("url"))).select(key, "url", "__p.host", "__p.path")
    rows = rows.withColumn("__r", fitting_rule(F.col("host"), F.col("path"), rules)).select(key, "url", "host", "path", "__r.rule", "__r.verdict")
    rows = rows.withColumn("label", F.when(F.col("verdict") == "block", 1.0).when(F.col("verdict") == "allow", 0.0))
    described = saved(features(rows), "url-features")
    model = fit(described.where("label is not null"), key, sample)
    ruled = described.where("rule is not null").select(key, "host", "path", "rule", "verdict", F.lit(None).cast("double").alias("score"))
    open_ = described.where("rule is null")
    if model is None:
        scored = open_.withColumn("score", F.lit(0.0))
    else:
        scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(open_)).withColumn("score", F.element_at(vector_to_array(F.col("probability")), 2))
    return ruled.unionByName(scored.select(key, "host", "path", "rule", F.when(F.col("score") > 0.5, "block").otherwise("allow").alias("verdict"), "score"))

