"""URL filters: explicit host and path rules first, then gradient-boosted trees on lexical features.

Everything is DataFrame functions and Spark's own tree learner; no Python runs on the executors. Labels for training come
with the labelled URLs; `seed_labels` makes them from a list of words known from abuse lists. The trees see only lexical
features, none of the words, so what they learn is how such URLs look, for hosts that no word gives away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, stored, unpacked_rows

#: (rule, verdict); a rule is a host, a slash and the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Words of hosts that make a URL a labelled example of what to block.
SEED_WORDS = ("spam", "pills", "casino", "bets", "adult", "track", "ads", "porn", "viagra", "poker", "malware", "phish", "xxx", "escort", "warez")
#: Labelled URLs that the learner takes at most, by order of a hash.
TRAIN_ROWS = 50_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or where there is no ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _suffix(host: Column) -> Column:
    """The host's last label."""
    return F.regexp_extract(host, r"([^.]*)$", 1)


def _log_length(c: Column) -> Column:
    return F.log1p(F.length(c).cast("double"))


def _share(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.greatest(F.length(c), F.lit(1))


def _entropy(c: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    marks = F.split(c, "")
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    counts = F.transform(F.array_distinct(marks), lambda x: F.size(F.filter(marks, lambda y: y == x)) / n)
    return F.aggregate(counts, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


FEATURES = ("url_length", "host_length", "path_length", "query_length", "host_labels", "depth", "digit_share", "host_digit_share", "hyphens", "host_hyphens", "longest_run", "entropy", "params", "https", "fragment", "extension", "suffix_share", "suffix_block_rate")


def lexical_features(df: DataFrame, url_col: str = "url") -> DataFrame:
    """df with host, path, suffix and the lexical features."""
    url, host, path = F.coalesce(F.col(url_col), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    host_part = F.regexp_extract(host, r"^(?:www\.)?(.*)$", 1)
    d = df.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    return d.withColumns(
        {
            "suffix": _suffix(host),
            "url_length": _log_length(url),
            "host_length": _log_length(host_part),
            "path_length": _log_length(path),
            "query_length": _log_length(query),
            "host_labels": F.regexp_count(host, F.lit(r"\.")).cast("double"),
            "depth": F.regexp_count(path, F.lit("/")).cast("double"),
            "digit_share": _share(url, "[0-9]"),
            "host_digit_share": _share(host_part, "[0-9]"),
            "hyphens": F.regexp_count(url, F.lit("-")).cast("double"),
            "host_hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
            "longest_run": F.array_max(F.transform(F.split(host, "[.-]"), lambda x: F.length(x))).cast("double"),
            "entropy": _entropy(host_part),
            "params": F.regexp_count(query, F.lit("=")).cast("double"),
            "https": url.startswith("https:").cast("double"),
            "fragment": F.contains(url, F.lit("#")).cast("double"),
            "extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
        }
    )


def seed_labels(host: Column) -> Column:
    """1.0 where a part of the host is a seed word, else 0.0."""
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, SEED_WORDS))).cast("double")


class UrlFilter:
    """Trees fitted to labelled URLs, with the statistics of suffixes that they were fitted with.

    Each different URL counts once, as bad if more than half of its rows are, so that copies weigh nothing; of those, the
    train_rows least by a hash are fitted on. A training row's suffix statistics leave out its own host.
    """

    def __init__(self, labelled: DataFrame, *, url_col: str = "url", label_col: str = "label", train_rows: int = TRAIN_ROWS, trees: int = 12, depth: int = 3):
        from pyspark.ml.classification import GBTClassifier

        self.url_col = url_col
        each = labelled.select(F.col(url_col), F.col(label_col).cast("double").alias("label")).where(F.col("label").isNotNull() & (host_of(F.col(url_col)) != ""))
        rows = each.groupBy(url_col).agg((F.avg("label") > 0.5).cast("double").alias("label"))
        host = host_of(F.col(url_col))
        by_host = stored(rows.groupBy(_suffix(host).alias("_suffix"), host.alias("_host")).agg(F.sum("label").alias("_bad"), F.count("*").alias("_n")), "url-hosts")
        found = by_host.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_bad"), F.lit(0.0)).alias("bad")).first()
        self.rows, self.rate, self.model = found["n"], found["bad"] / max(1, found["n"]), None
        #: One row a suffix; joined as a table, as suffixes may be many.
        self.suffixes = by_host.groupBy("_suffix").agg(F.sum("_bad").alias("_all_bad"), F.sum("_n").alias("_all"))
        if not 0 < self.rate < 1:
            return
        hashed = rows.withColumn("_h", F.xxhash64(url_col))
        last = hashed.select("_h").distinct().orderBy("_h").limit(train_rows).agg(F.max("_h")).first()[0]
        some = stored(hashed.where(F.col("_h") <= F.lit(last)).drop("_h"), "url-sample")
        bad, n = some.agg(F.sum("label"), F.count("*")).first()
        if not 0 < bad < n:
            return
        even = lexical_features(some, url_col).withColumn("weight", F.when(F.col("label") == 1, 0.5 * n / bad).otherwise(0.5 * n / (n - bad)))
        own = even.join(by_host, (F.col("suffix") == F.col("_suffix")) & (F.col("host") == F.col("_host")), "left").drop("_suffix", "_host")
        sample = self._assembled(own, ("_bad", "_n"))
        self.model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, maxBins=32, seed=7).fit(sample.select("features", "label", "weight").coalesce(4))

    def _assembled(self, rows: DataFrame, own: tuple[str, str] | None = None) -> DataFrame:
        """rows with the vector of features; the suffix's share and its smoothed share of bad ones leave out the columns of own counts."""
        from pyspark.ml.feature import VectorAssembler

        joined = rows.join(self.suffixes, rows["suffix"] == self.suffixes["_suffix"], "left")
        bad, n = (F.coalesce(F.col(c), F.lit(0)) for c in ("_all_bad", "_all"))
        if own:
            bad, n = bad - F.col(own[0]), n - F.col(own[1])
        with_rates = joined.withColumns({"suffix_share": n / max(1, self.rows), "suffix_block_rate": (bad + 20 * self.rate) / (n + 20)})
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_rates)

    def judge(self, urls: DataFrame, *, keep: list[str], rules=RULES) -> DataFrame:
        """keep, host, path, rule, verdict and score (the trees' 0 to 1, or the share of bad labels where they were all alike)."""
        rows = lexical_features(urls.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_keep"), F.col(self.url_col).alias(self.url_col)), self.url_col)
        if self.model is None:
            scored = rows.withColumn("score", F.lit(float(self.rate)))
        else:
            from pyspark.ml.functions import vector_to_array

            model = self.model.copy()
            scored = model.transform(self._assembled(rows)).withColumn("score", vector_to_array("probability")[1])
        by_rule = rule_of(F.col("host"), F.col("path"), rules)
        own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
        return unpacked_rows(scored.withColumn("_rule", by_rule), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", own).alias("verdict"), "score")


def filter_urls(pages: DataFrame, *, labelled: DataFrame | None = None, url_col: str = "url", keep: list[str] | None = None, rules=RULES) -> DataFrame:
    """Judge every URL: the longest fitting rule's verdict, else the trees'.

    labelled: (url, label) rows; by default the pages themselves with `seed_labels`. Null URLs and those without :// have
    an empty host and path, fit no rule and are judged by the trees on what they are; repeated rows are judged alike; with
    no labelled URLs, or all of one label, the score is the share of bad ones (0 for none); a kept column with a result's
    name gives way to it.
    """
    if labelled is None:
        labelled = pages.select(F.col(url_col)).withColumn("label", seed_labels(host_of(F.col(url_col))))
    return UrlFilter(labelled, url_col=url_col).judge(pages, keep=keep or ["page_id"], rules=rules)
