"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

All work is DataFrame functions and Spark's own tree learner.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, materialize, own_columns

MAX_LABELLED = 5000
LEXICAL = ("url_length", "host_length", "host_labels", "host_marks", "depth", "digit_ratio", "entropy", "n_params")
FEATURES = (*LEXICAL, "suffix_block_rate")
FOLDS = 4
DOUBT = 5  # labelled urls that the share of all counts as in a suffix's rate


@dataclass(frozen=True)
class UrlRule:
    action: str  # allow or block
    host: str
    path: str  # with its leading slash

    def __str__(self) -> str:
        return self.host + self.path


def add_parts(pages: DataFrame, url_column: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``: both empty for null urls and those without ``://``."""
    url = F.col(url_column)
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})


def matching_rule(rules: list[UrlRule]) -> tuple[Column, Column]:
    """The longest fitting rule of a short list, and its action, as expressions; null if none fits."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(str(r)), str(r))):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        name, action = F.when(fits, str(rule)).otherwise(name), F.when(fits, rule.action).otherwise(action)
    return name, action


def join_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule`` and ``rule_action`` for rule tables of any size (host, path, action).

    Each distinct host of ``pages`` is taken apart into its suffixes once and joined on them; the
    rules of a host come back as one array, of which a page takes the longest that fits its path.
    """
    c = own_columns(pages, "host", "fitting", "best")
    labels = F.split("host", r"\.")
    suffixes = pages.select("host").distinct().withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    own = rules.select(F.col("host").alias("suffix"), F.col("path").alias("rule_path"), "action")
    found = suffixes.join(own, "suffix").groupBy(F.col("host").alias(c["host"])).agg(F.collect_list(F.struct(F.char_length(F.concat("suffix", "rule_path")).alias("size"), F.concat("suffix", "rule_path").alias("name"), "rule_path", "action")).alias(c["fitting"]))
    best = F.array_max(F.filter(c["fitting"], lambda r: F.col("path").startswith(r["rule_path"])))
    joined = pages.join(found, F.col("host") == F.col(c["host"]), "left").withColumn(c["best"], best)
    return joined.withColumns({"rule": F.col(c["best"])["name"], "rule_action": F.col(c["best"])["action"]}).drop(*c.values())


def entropy(text: Column) -> Column:
    """Bits of information of a character of the text, 0 for the empty text."""
    size = F.char_length(text).cast("double")
    counts = F.transform(F.array_distinct(F.filter(F.split(text, ""), lambda x: x != "")), lambda x: (F.char_length(text) - F.char_length(F.replace(text, x, F.lit("")))).cast("double"))
    return F.when(size > 0, F.aggregate(counts, F.lit(0.0), lambda a, n: a - n / size * F.log2(n / size))).otherwise(0.0)


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features ``LEXICAL`` (double) of a url and its parts."""
    url = F.coalesce(url, F.lit(""))
    size = F.char_length(url).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "url_length": size,
        "host_length": F.char_length(host).cast("double"),
        "host_labels": F.size(F.split(host, r"\.")).cast("double"),
        "host_marks": F.char_length(F.regexp_replace(host, r"[^-0-9]+", "")).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
        "digit_ratio": F.when(size > 0, F.char_length(F.regexp_replace(url, r"[^0-9]+", "")) / size).otherwise(0.0),
        "entropy": entropy(url),
        "n_params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
    }


def suffix_of(host: Column) -> Column:
    """The last label of a host."""
    return F.element_at(F.split(host, r"\."), -1)


@dataclass
class UrlModel:
    """Trees on the features, and the block rates of suffixes (suffix, rate; at most one a labelled url)."""

    trees: GBTClassificationModel | None
    rates: DataFrame | None
    prior: float

    def verdict(self, pages: DataFrame, url_column: str = "url", output: str = "model_verdict") -> DataFrame:
        """Adds ``output`` (allow or block) to pages with ``host`` and ``path``; other columns stay as they are."""
        if self.trees is None:
            return pages.withColumn(output, F.lit("block" if self.prior > 0.5 else "allow"))
        c = own_columns(pages, *FEATURES, "suffix", "known", "rate", "features", "raw", "probability", "prediction")
        made = lexical_features(F.col(url_column), F.col("host"), F.col("path"))
        ready = pages.withColumns({c[f]: x for f, x in made.items()} | {c["suffix"]: suffix_of(F.col("host"))})
        rates = self.rates.select(F.col("suffix").alias(c["known"]), F.col("rate").alias(c["rate"]))
        ready = ready.join(F.broadcast(rates), F.col(c["suffix"]) == F.col(c["known"]), "left").withColumn(c["suffix_block_rate"], F.coalesce(c["rate"], F.lit(float(self.prior))))
        ready = VectorAssembler(inputCols=[c[f] for f in FEATURES], outputCol=c["features"]).transform(ready)
        trees = self.trees.copy().setFeaturesCol(c["features"]).setPredictionCol(c["prediction"]).setRawPredictionCol(c["raw"]).setProbabilityCol(c["probability"])
        return trees.transform(ready).withColumn(output, F.when(F.col(c["prediction"]) > 0.5, "block").otherwise("allow")).drop(*c.values())


def train(labelled: DataFrame, max_labelled: int = MAX_LABELLED, trees: int = 8, depth: int = 3, seed: int = 7) -> UrlModel:
    """Learns from ``labelled`` (url, host, path, blocked boolean, rule string).

    At most ``max_labelled`` distinct urls take part, chosen by a hash. ``rule`` says where a label
    comes from; null is a label given to that url alone. A suffix has a block rate, smoothed towards
    the share of all, only if its labels come from several rules: those of a single rule say what
    the rule says, and nothing about the suffix's other urls. The trees learn from rates that leave
    out the url's own fold of hosts, so the rate can't give the label away. Without urls of both
    kinds the verdict is the more frequent one, allow if there is none.
    """
    distinct = labelled.groupBy("url").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.max("blocked").cast("double").alias("label"), F.min("rule").alias("rule"))
    chosen = distinct.orderBy(F.xxhash64(F.lit(13), "url"), "url").limit(max_labelled)
    made = lexical_features(F.col("url"), F.col("host"), F.col("path"))
    fold = F.pmod(F.xxhash64(F.lit(17), "host"), F.lit(FOLDS)).alias("fold")
    sample = materialize(chosen.select("label", suffix_of(F.col("host")).alias("suffix"), fold, F.coalesce("rule", F.concat(F.lit("://"), "url")).alias("rule"), *[x.alias(f) for f, x in made.items()]), "url-sample")
    counts = sample.agg(F.count("*").alias("n"), F.sum("label").alias("bad")).first()
    n, bad = counts["n"], counts["bad"] or 0.0
    prior = bad / n if n else 0.0
    if not 0 < bad < n:
        return UrlModel(None, None, prior)

    def rate(bad: Column, n: Column, rules: Column) -> Column:
        return F.when(rules > 1, (bad + DOUBT * prior) / (n + DOUBT)).otherwise(prior)

    every, own = Window.partitionBy("suffix"), Window.partitionBy("suffix", "fold")
    rules = F.size(F.collect_set("rule").over(every))
    others = [F.sum(x).over(every) - F.sum(x).over(own) for x in ("label", F.lit(1))]
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample.withColumn("suffix_block_rate", rate(*others, rules))).select("label", "features")
    fitted = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed).fit(ready.coalesce(4))
    rates = sample.groupBy("suffix").agg(rate(F.sum("label"), F.count("*"), F.size(F.collect_set("rule"))).alias("rate"))
    return UrlModel(fitted, materialize(rates.coalesce(1), "suffix-rates"), prior)


def judge_urls(pages: DataFrame, rules: list[UrlRule], url_column: str = "url", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Adds ``host, path, rule, verdict`` to the columns of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest rule
    wins and gives the verdict. The urls that rules fit are the labelled ones from which the trees
    learn; the trees judge the others. Urls that are null or have no ``://`` have an empty host and
    path and are judged by the trees too. Repeated rows are judged alike; columns of these four names
    are replaced and all others left alone; empty tables give empty results.
    """
    name, action = matching_rule(rules)
    c = own_columns(pages, "action", "url", "model")
    parted = add_parts(pages.withColumn(c["url"], F.col(url_column)), c["url"]).withColumn("rule", name).withColumn(c["action"], action)
    labelled = parted.where(F.col(c["action"]).isNotNull()).select(F.col(c["url"]).alias("url"), "host", "path", (F.col(c["action"]) == "block").alias("blocked"), "rule")
    judged = train(labelled, max_labelled=max_labelled).verdict(parted, c["url"], c["model"])
    keep = [x for x in pages.columns if x not in ("host", "path", "rule", "verdict")]
    return judged.select(*keep, "host", "path", "rule", F.coalesce(c["action"], c["model"]).alias("verdict"))
