"""Two-sample and categorical statistics as DataFrame plans.

Values are reduced to their distinct values with counts, and running sums over these are made in
ranges. P-values are scalar functions of one-row results.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evenkeel.operators.numbering import running


def value_counts(rows: DataFrame, value: str, group: str) -> DataFrame:
    """Distinct values ``x`` with the counts ``c1`` (group true) and ``c2`` (group false)."""
    return rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count(F.when(F.col(group), 1)).alias("c1"), F.count(F.when(~F.col(group), 1)).alias("c2"))


def _cumulative(counts: DataFrame) -> DataFrame:
    sizes = counts.agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2"))
    upto = running(counts, "x", {"u1": "c1", "u2": "c2"}).join(F.broadcast(sizes), F.lit(True))
    return upto.select("x", "c1", "c2", F.try_divide("u1", "n1").alias("f1"), F.try_divide("u2", "n2").alias("f2"), "next")


def ks_statistic(rows: DataFrame, value: str, group: str) -> DataFrame:
    """Largest difference of the two empirical distributions, with both sizes."""
    return ks_of_counts(value_counts(rows, value, group))


def ks_of_counts(counts: DataFrame) -> DataFrame:
    """``ks_statistic`` of ``value_counts``."""
    c = _cumulative(counts)
    return c.agg(F.max(F.abs(F.col("f1") - F.col("f2"))).alias("ks"), F.sum("c1").alias("n1"), F.sum("c2").alias("n2"))


def cdf_area(rows: DataFrame, value: str, group: str) -> DataFrame:
    """Area between the two distributions, and divided by the range of the pooled values."""
    return cdf_area_of_counts(value_counts(rows, value, group))


def cdf_area_of_counts(counts: DataFrame) -> DataFrame:
    """``cdf_area`` of ``value_counts``."""
    c = _cumulative(counts)
    area = F.coalesce(F.sum(F.abs(F.col("f1") - F.col("f2")) * (F.col("next") - F.col("x"))), F.lit(0.0))
    out = c.agg(area.alias("area"), (F.max("x") - F.min("x")).alias("width"), F.sum("c1").alias("n1"), F.sum("c2").alias("n2"))
    empty = (F.col("n1") == 0) | (F.col("n2") == 0)
    return out.select("area", "width", F.when(empty, F.raise_error(F.lit("a group is empty"))).otherwise(F.when(F.col("area") == 0, 0.0).otherwise(F.col("area") / F.col("width"))).alias("difference"))


def mann_whitney(rows: DataFrame, value: str, group: str) -> DataFrame:
    """U statistics from midranks, the smaller one, and the tie-corrected z with continuity correction."""
    return mann_whitney_of_counts(value_counts(rows, value, group))


def mann_whitney_of_counts(counts: DataFrame) -> DataFrame:
    """``mann_whitney`` of ``value_counts``."""
    counts = counts.withColumn("c", F.col("c1") + F.col("c2"))
    ranks = running(counts, "x", {"upto": "c"}).withColumn("midrank", F.col("upto") - F.col("c") + (F.col("c") + 1) / 2)
    sums = ranks.agg(F.sum(F.col("midrank") * F.col("c1")).alias("r1"), F.sum("c1").cast("double").alias("n1"), F.sum("c2").cast("double").alias("n2"), F.sum((F.pow("c", F.lit(3.0)) - F.col("c"))).alias("ties"))
    n = F.col("n1") + F.col("n2")
    u1 = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    out = sums.withColumns({"u1": u1}).withColumn("u2", F.col("n1") * F.col("n2") - F.col("u1"))
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    top = F.greatest("u1", "u2")
    return out.select("u1", "u2", F.least("u1", "u2").alias("u"), F.when(sd > 0, (top - F.col("n1") * F.col("n2") / 2.0 - 0.5) / sd).alias("z"))


def kruskal_wallis(rows: DataFrame, value: str, group: str) -> DataFrame:
    """H statistic with the correction for ties, and its degrees of freedom."""
    return kruskal_wallis_of_counts(rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("x"), F.col(group).alias("g")).agg(F.count("*").alias("c")))


def kruskal_wallis_of_counts(cells: DataFrame) -> DataFrame:
    """``kruskal_wallis`` of the counts ``c`` of values ``x`` in groups ``g``."""
    values = cells.groupBy("x").agg(F.sum("c").alias("t"))
    ranks = running(values, "x", {"upto": "t"}).withColumn("midrank", F.col("upto") - F.col("t") + (F.col("t") + 1) / 2)
    ties = ranks.agg(F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"), F.sum("t").alias("n"))
    groups = cells.join(ranks, "x").groupBy("g").agg(F.sum(F.col("c") * F.col("midrank")).alias("r"), F.sum("c").alias("ng"))
    h = groups.agg(F.sum(F.col("r") * F.col("r") / F.col("ng")).alias("s"), F.count("*").alias("k")).join(ties, F.lit(True))
    n = F.col("n").cast("double")
    raw = 12.0 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    return h.select((raw / (1 - F.col("ties") / (n * n * n - n))).alias("h"), (F.col("k") - 1).alias("dof"))


def chi_square(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two categories over observed margins; with one degree of freedom each deviation is lessened by a half, without regard to its sign."""
    return chi_square_of_counts(rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o")))


def chi_square_of_counts(cells: DataFrame) -> DataFrame:
    """``chi_square`` of the counts ``o`` of the categories ``a`` and ``b``."""
    ra, cb = cells.groupBy("a").agg(F.sum("o").cast("double").alias("ra")), cells.groupBy("b").agg(F.sum("o").cast("double").alias("cb"))
    grid = ra.crossJoin(cb).join(cells, ["a", "b"], "left").fillna({"o": 0})
    grid = grid.withColumn("n", F.sum("ra").over(Window.partitionBy("b"))).withColumn("e", F.col("ra") * F.col("cb") / F.col("n"))
    dev = F.abs(F.col("o") - F.col("e"))
    sums = grid.agg(F.sum(dev * dev / F.col("e")).alias("plain"), F.sum((dev - 0.5) * (dev - 0.5) / F.col("e")).alias("yates"), ((F.countDistinct("a") - 1) * (F.countDistinct("b") - 1)).alias("dof"))
    return sums.select(F.when(F.col("dof") == 1, F.col("yates")).otherwise(F.col("plain")).alias("chi2"), "dof")


def mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information (nats), both entropies and its normalised forms; a ratio is 1 where an entropy is 0."""
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o"))
    n = F.sum("o").over(Window.partitionBy())
    pa, pb = F.sum("o").over(Window.partitionBy("a")), F.sum("o").over(Window.partitionBy("b"))
    p = cells.withColumns({"n": n, "na": pa, "nb": pb})
    mi = F.sum(F.col("o") / F.col("n") * F.log(F.col("o") * F.col("n") / (F.col("na") * F.col("nb"))))
    ha = -F.sum(F.col("o") / F.col("n") * F.log(F.col("na") / F.col("n")))
    hb = -F.sum(F.col("o") / F.col("n") * F.log(F.col("nb") / F.col("n")))
    out = p.agg(mi.alias("mi"), ha.alias("ha"), hb.alias("hb"))
    over_a, over_b = F.when(F.col("ha") > 0, F.col("mi") / F.col("ha")).otherwise(1.0), F.when(F.col("hb") > 0, F.col("mi") / F.col("hb")).otherwise(1.0)
    return out.withColumns({"mi_a": over_a, "mi_b": over_b}).withColumns({"amean": (F.col("mi_a") + F.col("mi_b")) / 2, "gmean": F.sqrt(F.col("mi_a") * F.col("mi_b")), "hmean": F.when(F.col("mi_a") + F.col("mi_b") > 0, 2 * F.col("mi_a") * F.col("mi_b") / (F.col("mi_a") + F.col("mi_b"))).otherwise(0.0)})


def prior_variance(rows: DataFrame, value: str, a: float = 1e-8, b: float = 1e-24) -> DataFrame:
    """Variance with a Gamma prior: (2b + sum of squares - sum**2 / n) / (2a + n)."""
    x = F.col(value)
    return rows.agg(((2 * b + F.sum(x * x) - F.sum(x) * F.sum(x) / F.count(x)) / (2 * a + F.count(x))).alias("variance"))


def gaussian_information(rows: DataFrame, value: str, group: str, a: float = 1e-8, b: float = 1e-24) -> DataFrame:
    """Mutual information of a value and a group under normal densities: H(all) - sum of weighted H(group)."""
    x = F.col(value)
    var = (2 * b + F.sum(x * x) - F.sum(x) * F.sum(x) / F.count(x)) / (2 * a + F.count(x))
    h = 0.5 * F.log(2 * math.pi * math.e * var)
    total = rows.agg(h.alias("h"), F.count(x).alias("n"))
    groups = rows.groupBy(group).agg(h.alias("hg"), F.count(x).alias("ng"))
    return groups.join(F.broadcast(total), F.lit(True)).agg((F.first("h") - F.sum(F.col("ng") / F.col("n") * F.col("hg"))).alias("mi"))


def gaussian_information_of_moments(total: DataFrame, groups: DataFrame, a: float, b: float) -> DataFrame:
    """``gaussian_information`` of the moments (n, var) of all and of each group; n times the variance is the sum of squares less the squared sum over n."""
    n = F.col("n")
    h = 0.5 * F.log(2 * math.pi * math.e * (2 * b + n * F.col("var")) / (2 * a + n))
    both = groups.select(n.alias("ng"), h.alias("hg")).join(F.broadcast(total.select("n", h.alias("h"))), F.lit(True))
    return both.agg((F.first("h") - F.sum(F.col("ng") / F.col("n") * F.col("hg"))).alias("mi"))


def gini(rows: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """Gini coefficient, by weights if given; equal values are one step of the curve."""
    w = F.col(weight) if weight else F.lit(1.0)
    steps = rows.groupBy(F.col(value).alias("x")).agg(F.sum(w).alias("w")).withColumn("xw", F.col("x") * F.col("w"))
    c = running(steps, "x", {"cw": "w", "cxw": "xw"})
    # Twice the area between the curve and the diagonal, by trapezia.
    area = F.sum((2 * F.col("cxw") - F.col("xw")) * F.col("w"))
    return c.agg((1 - area / (F.max("cw") * F.max("cxw"))).alias("gini"))


def linear_fit(rows: DataFrame, y: str, x: str) -> DataFrame:
    """Adds the fitted value of a simple regression and the residual."""
    line = rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    out = rows.join(F.broadcast(line), F.lit(True)).withColumn("fitted", F.col("intercept") + F.col("slope") * F.col(x))
    return out.withColumn("residual", F.col(y) - F.col("fitted")).drop("slope", "intercept")


def proportion_interval(rows: DataFrame, flag: str, z: float = 1.959963984540054) -> DataFrame:
    """Share of true flags with the Wilson interval with continuity correction."""
    n, p = F.col("n").cast("double"), F.col("x") / F.col("n")
    c = F.least(F.lit(0.5), F.abs(F.col("x") - 0.5 * n)) / n
    base = rows.agg(F.sum(F.col(flag).cast("int")).alias("x"), F.count(flag).alias("n"))

    def edge(sign: int):
        q = p + sign * c
        mid, half = q + z * z / (2 * n), z * F.sqrt(q * (1 - q) / n + z * z / (4 * n * n))
        return (mid + sign * half) / (1 + z * z / n)

    return base.select("x", "n", p.alias("share"), F.greatest(edge(-1), F.lit(0.0)).alias("low"), F.least(edge(1), F.lit(1.0)).alias("high"))


def two_proportions(rows: DataFrame, flag: str, group: str) -> DataFrame:
    """Chi-square of two proportions with Yates' correction, which no deviation exceeds."""
    s = rows.agg(*[F.sum((F.col(flag) & g).cast("int")).cast("double").alias(f"x{i}") for i, g in ((1, F.col(group)), (2, ~F.col(group)))], F.sum(F.col(group).cast("int")).cast("double").alias("n1"), F.sum((~F.col(group)).cast("int")).cast("double").alias("n2"))
    p = (F.col("x1") + F.col("x2")) / (F.col("n1") + F.col("n2"))
    delta = F.abs(F.col("x1") / F.col("n1") - F.col("x2") / F.col("n2"))
    yates = F.least(F.lit(0.5), delta / (1 / F.col("n1") + 1 / F.col("n2")))
    terms = F.lit(0.0)
    for i in (1, 2):
        for x, q in ((F.col(f"x{i}"), p), (F.col(f"n{i}") - F.col(f"x{i}"), 1 - p)):
            e = F.col(f"n{i}") * q
            terms = terms + F.pow(F.abs(x - e) - yates, F.lit(2.0)) / e
    return s.select((F.col("x1") / F.col("n1")).alias("p1"), (F.col("x2") / F.col("n2")).alias("p2"), terms.alias("chi2"))


# Scalars of one-row results


def ks_p_value(d: float, n1: int, n2: int) -> float:
    """Asymptotic two-sided p-value of the KS statistic, with the small-sample correction of its argument."""
    root = math.sqrt(n1 * n2 / (n1 + n2))
    t = (root + 0.12 + 0.11 / root) * d
    return min(1.0, max(0.0, 2 * math.fsum((-1) ** (j - 1) * math.exp(-2 * j * j * t * t) for j in range(1, 101))))


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_square_tail(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution by its closed sums."""
    if x <= 0:
        return 1.0
    if dof % 2 == 0:
        return math.exp(-x / 2) * math.fsum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))
    tail = math.erfc(math.sqrt(x / 2))
    return tail + math.exp(-x / 2) * math.fsum((x / 2) ** (i - 0.5) / math.gamma(i + 0.5) for i in range(1, (dof + 1) // 2))


def percentage_difference(a: float, b: float) -> float:
    return abs(a - b) / ((a + b) / 2) if a + b > 0 else 0.0
