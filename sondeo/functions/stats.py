"""Interval estimates, sample sizes and agreement metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .special import chi_square_p

Z95 = 1.959964


def wilson(k, n, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval, null if n is not positive."""
    n = n.cast("double")
    p, den = k / n, 1 + z * z / n
    mid = (p + z * z / (2 * n)) / den
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)), F.when(n > 0, F.least(F.lit(1.0), mid + half))


def rule_of_three(n) -> Column:
    return F.lit(3.0) / n


def sample_size(population, p: float = 0.5, error: float = 0.05, z: float = Z95) -> Column:
    """Sample for a proportion in a finite population."""
    n0 = z * z * p * (1 - p) / (error * error)
    return F.lit(n0) / (1 + (n0 - 1) / population)


def protocol(population, census_above: float = 0.5, small_below: int = 1200) -> Column:
    """Which reading protocol a number of comments asks for."""
    return F.when(F.ceil(sample_size(population)) / population > census_above, "B_censo").when(population < small_below, "intermedio_muestreo_reducido").otherwise("A_completo")


def rogan_gladen(p, sensitivity, specificity) -> Column:
    j = sensitivity + specificity - 1
    return F.when(j > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (p + specificity - 1) / j)))


def least_comments(n) -> Column:
    """Comments that a theme needs: three, or five percent."""
    return F.greatest(F.lit(3), F.ceil(n * 0.05)).cast("long")


def least_topic(n) -> Column:
    """Comments that a topic needs: five, or three percent."""
    return F.greatest(F.lit(5), F.ceil(n * 0.03)).cast("long")


def ratio(a, b) -> Column:
    return F.when(b != 0, a / b)


def confusion(y, yhat) -> list[Column]:
    y, yhat = y.cast("int"), yhat.cast("int")
    return [F.count_if((y == 1) & (yhat == 1)).alias("vp"), F.count_if((y == 0) & (yhat == 1)).alias("fp"), F.count_if((y == 1) & (yhat == 0)).alias("fn"), F.count_if((y == 0) & (yhat == 0)).alias("vn")]


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, specificity, F1 and kappa of rows with vp, fp, fn, vn."""
    vp, fp, fn, vn = (F.col(c).cast("double") for c in ("vp", "fp", "fn", "vn"))
    n = vp + fp + fn + vn
    po, pe = (vp + vn) / n, ((vp + fp) * (vp + fn) + (fn + vn) * (fp + vn)) / (n * n)
    return counts.select("*", ratio(vp, vp + fp).alias("precision"), ratio(vp, vp + fn).alias("recall"), ratio(vn, vn + fp).alias("specificity"), ratio(2 * vp, 2 * vp + fp + fn).alias("f1"), F.when(pe != 1, (po - pe) / (1 - pe)).otherwise(1.0).alias("kappa"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two label columns, from the counts of label pairs."""
    pairs = df.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).count()
    n = pairs.agg(F.sum("count").alias("n"), F.sum(F.when(F.col("x").eqNullSafe(F.col("y")), F.col("count")).otherwise(0)).alias("same"))
    left, right = pairs.groupBy("x").agg(F.sum("count").alias("nx")), pairs.groupBy("y").agg(F.sum("count").alias("ny"))
    chance = left.join(right, F.col("x") == F.col("y")).agg(F.coalesce(F.sum(F.col("nx").cast("double") * F.col("ny")), F.lit(0.0)).alias("c"))
    po, pe = F.col("same") / F.col("n"), F.col("c") / (F.col("n").cast("double") * F.col("n"))
    return n.join(F.broadcast(chance)).select(F.when(pe == 1, F.lit(1.0)).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def label_sets(facts: DataFrame, items: DataFrame, key: str, label: str, to: str) -> DataFrame:
    """Every item with its sorted set of labels, empty if it has none."""
    sets = facts.groupBy(key).agg(F.array_sort(F.collect_set(label)).alias(to))
    return items.select(key).distinct().join(sets, key, "left").withColumn(to, F.coalesce(to, F.array().cast("array<string>")))


def multilabel_metrics(sets: DataFrame, truth: str, guess: str, n_labels: int) -> DataFrame:
    """Micro F1, Hamming loss, exact match and mean Jaccard of rows with two label arrays."""
    both, either = F.size(F.array_intersect(truth, guess)), F.size(F.array_union(truth, guess))
    t, g = F.size(truth), F.size(guess)
    return sets.agg(
        ratio(2.0 * F.sum(both), F.sum(t + g)).alias("micro_f1"),
        (F.sum(t + g - 2 * both) / (F.count("*") * F.lit(float(n_labels)))).alias("hamming"),
        F.avg((F.array_sort(truth) == F.array_sort(guess)).cast("double")).alias("exact_match"),
        F.avg(F.when(either == 0, 1.0).otherwise(both / either)).alias("jaccard"),
    )


def macro_f1(counts: DataFrame) -> DataFrame:
    """Mean F1 of labels with vp, fp, fn; one without cases counts 0."""
    vp, fp, fn = (F.col(c).cast("double") for c in ("vp", "fp", "fn"))
    return counts.agg(F.avg(F.coalesce(ratio(2 * vp, 2 * vp + fp + fn), F.lit(0.0))).alias("macro_f1"))


def brier(p, y) -> Column:
    return F.avg(F.pow(p - y, 2))


def calibration(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins of equal width."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(p) * bins))
    each = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("p"), F.avg(y).alias("y"))
    return each.agg((F.sum(F.abs(F.col("p") - F.col("y")) * F.col("n")) / F.sum("n")).alias("ece"))


def chi_square(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Of each group of ``by``: chi-square without correction, its degrees of freedom and
    p-value, Cramer's V and the percentage of expected counts under 5.  A table of one row
    or column has no degrees, so p and V are null."""
    cells = df.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).count()
    rows, cols = cells.groupBy(*by, "a").agg(F.sum("count").alias("na")), cells.groupBy(*by, "b").agg(F.sum("count").alias("nb"))
    n = cells.groupBy(*by).agg(F.sum("count").cast("double").alias("n"))
    # the marginals of a contingency table
    grid = rows.join(cols, list(by)).join(n, list(by)) if by else rows.join(F.broadcast(n)).crossJoin(cols)
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*by, "a", "b")]
    grid = grid.withColumn("e", F.col("na") * F.col("nb") / F.col("n")).alias("g").join(cells.alias("c"), same, "left").select("g.*", "count")
    out = grid.groupBy(*by).agg(F.sum(F.pow(F.coalesce("count", F.lit(0)) - F.col("e"), 2) / F.col("e")).alias("chi2"), F.count_distinct(F.struct("a")).alias("r"), F.count_distinct(F.struct("b")).alias("c"), F.max("n").alias("n"), F.avg((F.col("e") < 5).cast("double")).alias("low"))
    df_, least = (F.col("r") - 1) * (F.col("c") - 1), F.least("r", "c") - 1
    return out.select(*by, "chi2", df_.alias("gl"), chi_square_p(F.col("chi2"), df_).alias("p"), F.sqrt(F.col("chi2") / (F.col("n") * F.nullif(least, F.lit(0)))).alias("cramer_v"), (F.col("low") * 100).alias("pct_low"))


def benjamini_hochberg(df: DataFrame, p: str, q: float = 0.05, by: str | None = None) -> DataFrame:
    """``df`` with adjusted p-values ``p_adj`` and ``reject``, within groups of ``by``."""
    part = [by] if by else []
    order = Window.partitionBy(*part).orderBy(p)
    ranked = df.withColumns({"_r": F.row_number().over(order), "_m": F.count("*").over(Window.partitionBy(*part))})
    tail = Window.partitionBy(*part).orderBy("_r").rowsBetween(0, Window.unboundedFollowing)
    adj = F.least(F.lit(1.0), F.min(F.col("_m") * F.col(p) / F.col("_r")).over(tail))
    return ranked.withColumn("p_adj", adj).withColumn("reject", F.col("p_adj") <= q).drop("_r", "_m")


def bootstrap_mean(df: DataFrame, x: str, draws: int = 2000, seed: int = 42, key: str = "id") -> DataFrame:
    """Percentile interval of the mean: each row counts a Poisson number of times in each
    draw, by a hash of its key, so all draws are made in one pass without shuffling rows
    (each task sums its rows by draw first)."""
    cut, total, term = [], 0.0, math.exp(-1)
    for i in range(1, 8):  # the distribution function of Poisson(1)
        total += term
        cut.append(total)
        term /= i
    name = F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col("draw").cast("string"))
    u = (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") + 0.5) / float(1 << 32)
    each = df.filter(F.col(x).isNotNull()).select(key, x, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).select(x, "draw", u.alias("u"))
    times = sum(((F.col("u") > c).cast("int") for c in cut[1:]), (F.col("u") > cut[0]).cast("int"))
    means = each.withColumn("w", times).groupBy("draw").agg((F.sum(F.col(x) * F.col("w")) / F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))


#: A Poisson number of at least this mean is drawn from the normal distribution.
NORMAL_FROM = 32


def bootstrap(df: DataFrame, columns: list[str], statistic: Column, draws: int = 2000, seed: int = 42, by: list[str] = ()) -> DataFrame:
    """Percentile interval ``(by..., lo, hi)`` of any statistic of a table's rows.  ``statistic``
    is an aggregate over ``columns`` and the weight ``w``, such as ``sum(w * x) / sum(w)``.

    Rows are counted by their different values first.  In each draw a value of c rows
    weighs a Poisson number of mean c, as do c rows that each weigh one of mean 1; it comes
    from a hash of seed, value and draw, so the result doesn't hang on partitions.  Cost
    follows values x draws, whatever the number of rows.  Draws without a defined
    statistic are left out.  Below a mean of 32 the number is drawn exactly, else as a rounded normal one."""
    counts = df.groupBy(*by, *columns).agg(F.count("*").cast("double").alias("c"))
    name = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*by, *columns)), F.col("draw").cast("string"))
    digest = F.md5(name)
    part = lambda at: (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") + 0.5) / float(1 << 32)
    each = counts.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumns({"u": part(1), "v": part(9)})
    normal = F.greatest(F.lit(0.0), F.round(F.col("c") + F.sqrt("c") * F.sqrt(-2 * F.ln("u")) * F.cos(2 * math.pi * F.col("v"))))
    # the number of i whose distribution function lies below u, up to where it is 1
    begin = F.struct(F.exp(-F.col("c")).alias("term"), F.exp(-F.col("c")).alias("sum"), F.lit(0.0).alias("w"))
    step = lambda s, i: F.struct((s["term"] * F.col("c") / i).alias("term"), (s["sum"] + s["term"] * F.col("c") / i).alias("sum"), (s["w"] + (F.col("u") > s["sum"]).cast("double")).alias("w"))
    exact = F.aggregate(F.sequence(F.lit(1), F.lit(4 * NORMAL_FROM)), begin, step, lambda s: s["w"])
    weighted = each.withColumn("w", F.when(F.col("c") < NORMAL_FROM, exact).otherwise(normal))
    values = weighted.groupBy(*by, "draw").agg(statistic.cast("double").alias("s")).filter(F.col("s").isNotNull() & ~F.isnan("s"))
    ends = [F.percentile("s", 0.025).alias("lo"), F.percentile("s", 0.975).alias("hi")]
    return values.groupBy(*by).agg(*ends) if by else values.agg(*ends)


def weighted_f1(y: str, g: str) -> Column:
    """F1 of the label 1 under weights ``w``: for :func:`bootstrap`."""
    hit = F.sum(F.col("w") * ((F.col(y) == 1) & (F.col(g) == 1)).cast("int"))
    return ratio(2.0 * hit, F.sum(F.col("w") * (F.col(y) + F.col(g))))


def weighted_kappa(y: str, g: str) -> Column:
    """Cohen's kappa of two 0/1 columns under weights ``w``: for :func:`bootstrap`."""
    n, same = F.sum("w"), F.sum(F.col("w") * (F.col(y) == F.col(g)).cast("int"))
    a, b = F.sum(F.col("w") * F.col(y)), F.sum(F.col("w") * F.col(g))
    chance = (a * b + (n - a) * (n - b)) / (n * n)
    return F.when((n > 0) & (chance != 1), (same / n - chance) / (1 - chance))
