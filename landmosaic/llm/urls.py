"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the URLs that no rule fits."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import met, written

#: The trees are fitted on at most about so many different labelled URLs, drawn by hash; suffix statistics take all of them.
FIT_ROWS = 50_000
TREES, DEPTH, SEED = 20, 4, 1
#: Labelled URLs of a suffix are weighed against so many at the corpus's rate. Rows that are fitted get the rate without their own fold.
PRIOR, FOLDS = 10.0, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first '://' up to '/', '?' or '#', A-Z lower-cased; then up to '?' or '#'. Both empty for null and without '://'."""
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """rule and verdict of the longest of the rules (verdict, host, path) that fits, null if none does; of two as long block wins, then the greater text.

    A rule fits its host and all subdomains, if the path starts with the rule's. The rules are a parameter: they are looked at in each row.
    """
    if not rules:
        return F.expr("cast(NULL AS struct<size: int, block: boolean, rule: string>)")
    rows = [F.struct(F.lit(len(h + p)).alias("size"), F.lit(verdict == "block").alias("block"), F.lit(h + p).alias("rule"), F.lit(h).alias("h"), F.lit(p).alias("p")) for verdict, h, p in rules]
    fits = lambda r: ((host == r["h"]) | host.endswith(F.concat(F.lit("."), r["h"]))) & path.startswith(r["p"])
    return F.array_max(F.filter(F.array(*rows), fits))


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    """The groups whose statistics describe a URL: last label, last two and last three of the host; first part and extension of the path."""
    label = lambda n: F.substring_index(host, ".", -n)
    return {"top": label(1), "domain": label(2), "site": label(3), "head": F.regexp_extract(path, "^/([^/]*)", 1), "extension": F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]{1,8})$", 1))}


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for an empty text."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    kinds = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.coalesce(F.aggregate(kinds, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))), F.lit(0.0))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lengths, depths, shares of digits, entropy and counts, from the text alone."""
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, "(?s)\\?([^#]*)", 1)
    many = lambda t, pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    share = lambda t, pattern: F.coalesce(F.try_divide(many(t, pattern), F.length(t)), F.lit(0.0))
    out = {"length": F.length(text), "host_length": F.length(host), "path_length": F.length(path), "host_depth": many(host, "[^.]+"), "path_depth": many(path, "[^/]+"), "parameters": many(query, "[^&]+")}
    out |= {"digit_ratio": share(text, "[0-9]"), "host_digit_ratio": share(host, "[0-9]"), "hyphens": many(host, "-"), "fragment": text.contains("#").cast("int"), "entropy": entropy(text), "host_entropy": entropy(host)}
    return {k: v.cast("double") for k, v in out.items()}


def parsed(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, url, host, path, rule, blocked (of the rule, null without one) of each page."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    found = rows.withColumn("found", ruled(F.col("host"), F.col("path"), rules))
    return found.select("page_id", "url", "host", "path", F.col("found.rule").alias("rule"), F.col("found.block").alias("blocked"))


def _fold() -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(FOLDS))


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """suffix ('kind:text'), n_urls, n_labelled and n_blocked (arrays by fold) over all rows; written."""
    kinds = suffixes(F.col("host"), F.col("path"))
    each = rows.select(F.explode(F.array(*(F.concat(F.lit(f"{k}:"), v) for k, v in kinds.items()))).alias("suffix"), _fold().alias("fold"), "blocked")
    by_fold = lambda value: F.array(*(F.sum(F.when(F.col("fold") == f, value.cast("long")).otherwise(0)) for f in range(FOLDS)))
    sums = each.groupBy("suffix").agg(F.count("*").alias("n_urls"), by_fold(F.col("blocked").isNotNull()).alias("n_labelled"), by_fold(F.coalesce("blocked", F.lit(False))).alias("n_blocked"))
    return written(sums)


def described(rows: DataFrame, statistics: DataFrame, rate: float, own_fold: bool) -> DataFrame:
    """rows with `features`: the lexical ones and, for each suffix, the log of its number of URLs and its smoothed share of blocked ones.

    Without own_fold the shares come from the labelled URLs of the other folds.
    """
    out = rows
    total = lambda c: F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x) - (F.lit(0) if own_fold else F.col(c)[_fold().cast("int")]), F.lit(0))
    names = []
    for kind, key in suffixes(F.col("host"), F.col("path")).items():
        known = statistics.where(F.col("suffix").startswith(f"{kind}:"))
        out = met(out.withColumn("suffix", F.concat(F.lit(f"{kind}:"), key)), known, "suffix", "n_urls")
        share = (total("n_blocked") + PRIOR * rate) / (total("n_labelled") + PRIOR)
        out = out.withColumns({f"{kind}_count": F.log1p(F.coalesce("n_urls", F.lit(0)).cast("double")), f"{kind}_share": share}).drop("suffix", "n_urls", "n_labelled", "n_blocked")
        names += [f"{kind}_count", f"{kind}_share"]
    text = lexical(F.col("url"), F.col("host"), F.col("path"))
    wide = out.withColumns({f"x_{k}": v for k, v in text.items()})
    return VectorAssembler(inputCols=[*(f"x_{k}" for k in text), *names], outputCol="features").transform(wide).select(*rows.columns, "features")


def fitted(rows: DataFrame, statistics: DataFrame) -> GBTClassificationModel | float:
    """Boosted trees for the labelled rows (blocked isn't null); the share of blocked ones where there aren't two classes (0 without any)."""
    labelled = rows.where("blocked IS NOT NULL")
    n, blocked = labelled.agg(F.count("*"), F.count_if("blocked")).first()
    rate = blocked / n if n else 0.0
    if rate in (0.0, 1.0):
        return rate
    parts = 2**20
    drawn = labelled.where(F.pmod(F.xxhash64("url", F.lit(SEED)), F.lit(parts)) < parts * min(1.0, FIT_ROWS / n)).dropDuplicates(["url"])
    train = written(described(drawn, statistics, rate, own_fold=False).select("features", F.col("blocked").cast("double").alias("label")))
    if train.agg(F.count_distinct("label")).first()[0] < 2:
        return rate
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, maxBins=64, seed=SEED).fit(train)


def judged(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, url, host, path, rule, p_block, verdict of each row of pages (page_id, url).

    Where a rule fits, the longest one decides. The URLs that a rule judges are the labelled ones: on them boosted trees are
    fitted over lexical features and the statistics of suffixes (counted over all rows), and they judge the rest: block from a
    probability of a half on. Without labelled URLs of both kinds all others get the only verdict there is (allow without
    any). A null or empty url has empty host and path and goes to the trees like others; repeated rows keep their number; further
    columns are ignored; an empty table gives no rows.
    """
    rows = written(parsed(pages, rules))
    statistics = suffix_statistics(rows)
    model = fitted(rows, statistics)
    if isinstance(model, float):
        scored = rows.withColumn("p_block", F.lit(model))
    else:
        n, blocked = rows.agg(F.count("blocked"), F.count_if("blocked")).first()
        wide = described(rows, statistics, blocked / n, own_fold=True)
        scored = model.transform(wide).withColumn("p_block", vector_to_array("probability")[1])
    block = F.coalesce("blocked", F.col("p_block") >= 0.5)
    return scored.select("page_id", "url", "host", "path", "rule", "p_block", F.when(block, "block").otherwise("allow").alias("verdict"))
