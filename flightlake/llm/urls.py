"""URL filters: rules first, then gradient-boosted trees on lexical features.

Rules name a host and a path prefix; the longest that fits decides.  URLs without a rule are judged
by trees that were trained on labelled URLs: length, depth, digit ratio, entropy, parameter counts and
statistics of the host's suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, table

#: (host, path, verdict): fits the host and its subdomains where the path starts with the rule's.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Most labelled URLs that the trees are trained on, chosen by a hash of the URL.
MAX_TRAINING_URLS = 20_000
ROUNDS, DEPTH, STEP = 12, 4, 0.3
FEATURES = ["length", "host_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "entropy", "params", "hyphens", "longest_label", "suffix_share", "suffix_digits", "suffix_depth"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end.

    Null, or without ``://``: both empty.
    """
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def entropy(text: Column) -> Column:
    """Bits per character of a string's characters; 0 for the empty string."""
    n = F.greatest(F.length(text), F.lit(1))
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda ch: F.length(text) - F.length(F.replace(text, ch, F.lit(""))))
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.aggregate(counts, F.lit(0.0), lambda s, c: s - F.when(c > 0, (c / n) * F.log2(c / n)).otherwise(0.0)))


def lexical(df: DataFrame) -> DataFrame:
    """Adds the lexical features of (url, host, path), and the suffix: the host's last two labels."""
    u, host = F.coalesce(F.col("url"), F.lit("")), F.col("host")
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", ""))
    one = lambda c: F.greatest(F.length(c), F.lit(1))
    query = F.regexp_extract(u, r"(?s)^[^?#]*\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    return df.select(
        "*",
        F.length(u).cast("double").alias("length"),
        F.length(host).cast("double").alias("host_length"),
        F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double").alias("depth"),
        F.size(labels).cast("double").alias("labels"),
        (digits(u) / one(u)).alias("digit_ratio"),
        (digits(host) / one(host)).alias("host_digit_ratio"),
        entropy(u).alias("entropy"),
        F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double").alias("params"),
        F.length(F.regexp_replace(u, "[^-]", "")).cast("double").alias("hyphens"),
        F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double").alias("longest_label"),
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("suffix"),
    )


def judge(df: DataFrame, key: str, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """(key, host, path, rule, verdict, probability) for every row of (key, url).

    ``labelled`` (url, blocked 0/1) trains the trees; without it the verdicts of the rules on the rows
    that have one are the labels.  Suffix statistics are counted over all rows.  With no label of
    either class, the trees are left out and the verdict without a rule is the known class (allow if none).
    Null and malformed URLs have an empty host and path and are judged like any other;
    repeated rows come out repeated; other columns are not read.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    def parsed(rows: DataFrame) -> DataFrame:
        host, path = host_and_path(F.col("url"))
        return rows.withColumn("host", host).withColumn("path", path)

    rows = parsed(df.select(F.col(key).alias("_key"), "url")).withColumn("_r", rule_for(F.col("host"), F.col("path"), rules))
    feats = lexical(rows)
    known = F.when(F.col("_r.verdict") == "block", 1.0).when(F.col("_r.verdict") == "allow", 0.0)
    # counted per suffix over all rows, summed before the shuffle
    stats = feats.groupBy("suffix").agg(F.count("*").alias("n"), F.avg("digit_ratio").alias("suffix_digits"), F.avg("depth").alias("suffix_depth"))
    stats = materialize(stats, "suffixes")
    total = stats.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    stats = stats.select("suffix", (F.log1p("n") / F.log1p(F.lit(max(1, total)))).alias("suffix_share"), "suffix_digits", "suffix_depth")
    full = materialize(feats.join(stats, "suffix"), "urls")
    if labelled is None:
        train = full.where(F.col("_r").isNotNull()).withColumn("label", known)
    else:
        train = lexical(parsed(labelled.select("url", F.col("blocked").cast("double").alias("label")))).join(stats, "suffix", "left")
        train = train.fillna(0.0, ["suffix_share", "suffix_digits", "suffix_depth"])
    train = train.select("label", "url", *FEATURES).orderBy(F.xxhash64("url"), "url").limit(MAX_TRAINING_URLS)
    train = materialize(train.coalesce(4), "labelled")
    classes = {r.label for r in train.select("label").distinct().collect()}
    pack = VectorAssembler(inputCols=FEATURES, outputCol="features")
    if len(classes) == 2:
        model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=STEP, seed=7, maxMemoryInMB=64, cacheNodeIds=False).fit(pack.transform(train).select("features", "label"))
        out = model.transform(pack.transform(full)).withColumn("probability", vector_to_array("probability")[1])
    else:
        out = full.withColumn("probability", F.lit(float(classes == {1.0})))
    verdict = F.coalesce(F.col("_r.verdict"), F.when(F.col("probability") >= 0.5, "block").otherwise("allow"))
    return out.select(F.col("_key").alias(key), "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "probability")


def op7_url_filter(spark, sf_dir) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), "page_id")
