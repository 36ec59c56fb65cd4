"""Quality rules: base counts of whole texts and robust multivariate outliers.

Everything is DataFrame operations.  A text's statistics are made inside its row with array
functions (no shuffle).  Transformed statistics of the rows that pass the base rules are
judged within their language and source by a minimum-covariance-determinant estimate.  It is
found by concentration steps (mean and covariance of the ``share`` of rows nearest so far,
distances from them, the nearest rows again) from two deterministic starts, until no
determinant changes any more; the start with the least determinant counts.

The distances of real texts have heavier tails than a chi-square variable, as in short ones a
single number or name moves a share a good deal.  So the cutoff is taken from the distances
themselves, without any label: the fence of a box plot of their logarithms over all rows
(upper quartile plus one and a half interquartile ranges), never below the 0.9999 quantile of
chi-square (23.5), which it comes near to for normal data (25).  A quarter of the rows can
be junk without moving it much.

The statistics vary in clean text and are correlated there (longer words go with more
different ones), so the covariance decides how far is far.  A group's estimate is blended
with its language's, and a language's with that of all rows, each weighing as much as
``prior`` rows: a large group stands on its own rows, a small one leans on its language, and
no size is treated by another rule.

Each step is an aggregation by group with partial sums, and a join with one small row of
parameters for each group, so a source with a third of all rows is summed in many tasks.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

SPACE = r"[\x09-\x0D\x20]+"
SYMBOLS = r"[#*$%&|<>]+"
#: Words of letters alone.
PLAIN_WORD = r"(?<![^\x09-\x0D\x20])\p{L}+(?![^\x09-\x0D\x20])"
#: Transformed statistics: mean word length, share of capitals among letters, share of words
#: with other than letters, and the growth of the vocabulary with the text's length.
FEATURES = (
    "ln(word_chars / n_words)",
    "asin(sqrt(n_capitals / greatest(n_letters, 1)))",
    "asin(sqrt((n_words - n_plain) / n_words))",
    "ln(n_distinct) / ln(n_words)",
)
DIM = len(FEATURES)
#: The least spread of a statistic, where all rows agree.
LEAST_SPREAD = 1e-3
#: The 0.9999 quantile of a chi-square variable with DIM degrees of freedom: no cutoff is below it.
LEAST_CUTOFF = 23.5
#: Interquartile ranges of the log distances beyond their upper quartile: the usual fence of a box plot.
FENCE = 1.5
#: Groups whose parameters are broadcast, some hundred bytes each; with more groups they are shuffled.
MOST_GROUPS = 100_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_letters", "n_capitals", "n_plain", "n_distinct", "n_repeat_words")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` and with ``COUNTS`` (long) of the whole text; null counts
    as empty.  Columns of these names are replaced, any others pass through.

    A word in a three-word window that occurs at least twice in its text is found by sorting
    the windows' hashes with their places and looking at the neighbours."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in (text, *COUNTS)), F.lit(0).alias("one_more"))
    rows = docs.select(row.alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = rows.select("row", "t", F.filter(F.split("t", SPACE), lambda x: x != "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x09-\x0D\x20]")).alias("l"))
    word = lambda i: F.get(F.col("w"), i)
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.struct(F.xxhash64(word(i), word(i + 1), word(i + 2)).alias("h"), i.alias("p")))
    rows = rows.select(
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace("t", r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("t", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        F.regexp_count("t", F.lit(PLAIN_WORD)).cast("long").alias("n_plain"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.when(F.size("w") >= 4, F.array_sort(windows)).alias("s"),
    )
    s = F.col("s")
    met = F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["p"]))
    rows = rows.withColumn("p", F.array_sort(F.filter(met, lambda x: x.isNotNull()))).drop("s")
    p = F.col("p")
    steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
    covered = F.aggregate(steps, F.lit(0), lambda a, x: a + x)
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return rows.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in (text, *COUNTS)), *COUNTS)


def consistency(share: float) -> float:
    """By how much the covariance of the nearest ``share`` of a normal sample in four
    dimensions falls short of the whole one's."""
    low, high = 0.0, 200.0
    for _ in range(100):  # the quantile of the chi-square variable with 4 degrees of freedom
        x = (low + high) / 2
        low, high = (x, high) if 1 - math.exp(-x / 2) * (1 + x / 2) < share else (low, x)
    return share / (1 - math.exp(-low / 2) * (1 + low / 2 + low * low / 8))


def _total(parts) -> Column:
    return reduce(lambda a, b: a + b, parts)


PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]
X, M, C, L = [f"x{i}" for i in range(DIM)], [f"m{i}" for i in range(DIM)], [f"c{i}{j}" for i, j in PAIRS], [f"l{i}{j}" for i, j in PAIRS]


def _quantile(x, q: float) -> Column:
    return F.percentile_approx(x, q, 10_000)


def _distance() -> Column:
    """Squared Mahalanobis distance of x from the mean m, by the Cholesky factor l."""
    y: list[Column] = []
    for i in range(DIM):
        y.append((F.col(X[i]) - F.col(M[i]) - _total([F.lit(0.0), *(F.col(f"l{i}{j}") * y[j] for j in range(i))])) / F.col(f"l{i}{i}"))
    return _total(v * v for v in y)


def _factored(rows: DataFrame) -> DataFrame:
    """Rows with means and covariances, and their Cholesky factors and log determinant."""
    for i, j in PAIRS:
        c = F.col(f"c{i}{j}") - _total([F.lit(0.0), *(F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j))])
        rows = rows.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(LEAST_SPREAD**2 / 100))) if i == j else c / F.col(f"l{j}{j}"))
    return rows.withColumn("logdet", _total(2 * F.ln(F.col(f"l{i}{i}")) for i in range(DIM)))


def _estimate(nearest: DataFrame, spread: DataFrame, share: float, prior: float) -> DataFrame:
    """Of each group and start, the mean and covariance of ``nearest``, blended with those
    of its parent, from all rows down to language and source."""
    sums = nearest.groupBy("level", "grp", "parent", "start").agg(F.count("*").alias("n"), *(F.avg(x).alias(m) for x, m in zip(X, M)), *(F.avg(F.col(X[i]) * F.col(X[j])).alias(f"c{i}{j}") for i, j in PAIRS))
    raw = sums.withColumns({f"c{i}{j}": (F.col(f"c{i}{j}") - F.col(M[i]) * F.col(M[j])) * consistency(share) for i, j in PAIRS})
    raw = staged(raw, "sums")
    above = spread.filter("level = 0").select(F.lit("").alias("up"), F.explode(F.array(F.lit(0), F.lit(1))).alias("of"), *(F.col(m).alias(f"p{m}") for m in M), *((F.pow(f"s{i}", 2) if i == j else F.lit(0.0)).alias(f"pc{i}{j}") for i, j in PAIRS))
    out = None
    for level in range(3):
        own = raw.filter(F.col("level") == level).join(above, (F.col("parent") == F.col("up")) & (F.col("start") == F.col("of")))
        blend = lambda c: ((F.col("n") * F.col(c) + prior * F.col(f"p{c}")) / (F.col("n") + prior)).alias(c)
        own = own.select("level", "grp", "start", *(blend(c) for c in (*M, *C)))
        above = own.select(F.col("grp").alias("up"), F.col("start").alias("of"), *(F.col(c).alias(f"p{c}") for c in (*M, *C)))
        out = own if out is None else out.unionByName(own)
    return _factored(out).select("level", "grp", "start", *M, *L, "logdet")


def outlier_distances(rows: DataFrame, features: tuple = FEATURES, lang: str = "lang", source: str = "source", share: float = 0.5, prior: float = 50.0, most_steps: int = 100, tolerance: float = 0.01) -> DataFrame:
    """``rows`` with ``d2``, the squared Mahalanobis distance of the transformed statistics
    from the minimum-covariance-determinant estimate of the row's language and source.  A
    null language or source is a group like any other.  Steps go on until no log determinant
    changes by ``tolerance``; determinants only fall, so that is some ten, and after
    ``most_steps`` an error is raised.  An empty table gives no rows."""
    key = lambda level, *c: F.to_json(F.struct(F.lit(level).alias("level"), *(F.col(f"`{x}`").cast("string").alias(f"k{i}") for i, x in enumerate(c))))
    at = [F.lit("all"), key(1, lang), key(2, lang, source)]
    value = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), at[2].alias("grp"), F.array(*(F.struct(F.lit(i).alias("level"), a.alias("grp"), (at[i - 1] if i else F.lit("")).alias("parent")) for i, a in enumerate(at))).alias("groups"), *(F.expr(e).cast("double").alias(x) for e, x in zip(features, X)))
    value = staged(value, "transformed")
    only = value.select(F.inline("groups"), *X)
    centre = staged(only.groupBy("level", "grp").agg(*(_quantile(x, 0.5).alias(m) for x, m in zip(X, M))), "centres")
    small = centre.count() <= MOST_GROUPS
    sent = F.broadcast if small else lambda df: df  # one row a group, and as many in every table of parameters
    spread = only.join(sent(centre.drop("level")), "grp").groupBy("level", "grp").agg(F.count("*").alias("n"), *(F.max(m).alias(m) for m in M), *(F.greatest(_quantile(F.abs(F.col(x) - F.col(m)), 0.5) * 1.4826, F.lit(LEAST_SPREAD)).alias(f"s{i}") for i, (x, m) in enumerate(zip(X, M))))
    spread = staged(spread, "spreads")
    base = spread.filter("level = 0").select(*(F.col(c).alias(f"all_{c}") for c in (*M, *(f"s{i}" for i in range(DIM)))))
    blend = lambda c: (F.col("n") * F.col(c) + prior * F.col(f"all_{c}")) / (F.col("n") + prior)
    begin = spread.join(base).select("grp", *(blend(c).alias(c) for c in (*M, *(f"s{i}" for i in range(DIM)))))  # base is one row
    z = [(F.col(X[i]) - F.col(M[i])) / F.col(f"s{i}") for i in range(DIM)]
    starts = F.array(F.struct(F.lit(0).alias("start"), _total(v * v for v in z).alias("d2")), F.struct(F.lit(1).alias("start"), F.greatest(*(F.abs(v) for v in z)).alias("d2")))
    near, model = only.join(sent(begin), "grp").select("level", "grp", "parent", *X, F.inline(starts)), None
    for _ in range(most_steps):
        cut = staged(near.groupBy("grp", "start").agg(_quantile("d2", share).alias("cut")), "cuts")
        last, model = model, staged(_estimate(near.join(sent(cut), ["grp", "start"]).filter("d2 <= cut"), spread, share, prior), "estimates")
        near = only.join(sent(model.drop("level")), "grp").withColumn("d2", _distance())
        if last is not None:
            moved = model.join(last.select("grp", "start", F.col("logdet").alias("before")), ["grp", "start"]).agg(F.max(F.abs(F.col("logdet") - F.col("before")))).first()[0]
            if moved is None or moved < tolerance:
                break
    else:
        raise ArithmeticError(f"no stable estimate after {most_steps} steps")
    best = model.groupBy("grp").agg(F.min_by(F.struct(*M, *L), F.struct("logdet", "start")).alias("best")).select("grp", "best.*")
    return value.join(sent(best), "grp").select("row.*", _distance().alias("d2"))


def cutoff_of(distances: DataFrame, fence: float = FENCE) -> DataFrame:
    """One row ``cutoff``: the fence of the log distances, LEAST_CUTOFF at least."""
    q = distances.agg(*(_quantile(F.ln(F.greatest("d2", F.lit(1e-12))), x).alias(n) for n, x in (("low", 0.25), ("high", 0.75))))
    return q.select(F.greatest(F.lit(LEAST_CUTOFF), F.coalesce(F.exp(F.col("high") + fence * (F.col("high") - F.col("low"))), F.lit(LEAST_CUTOFF))).alias("cutoff"))


def quality_rules(docs: DataFrame, min_words: int = 50, cutoff: float | None = None, **how) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, counts of :func:`statistics`,
    ``base_failed`` (under ``min_words`` words, or over half of the words in repeated
    three-word windows), ``d2`` (null where the base rules failed) and ``kept``: ``d2`` is
    ``cutoff`` at most (None: the fence of the distances, see :func:`cutoff_of`).

    A null or empty text has no words and fails.  Repeated rows and null doc_ids are judged
    like any other row; further columns are ignored; an empty table gives no rows."""
    stats = statistics(docs.select(F.col("doc_id").cast("long"), F.col("text"), F.col("lang").cast("string"), F.col("source").cast("string")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = staged(stats.withColumn("base_failed", failed), "statistics")
    passed = staged(outlier_distances(stats.filter("not base_failed"), **how), "distances")
    bound = cutoff_of(passed) if cutoff is None else docs.sparkSession.range(1).select(F.lit(float(cutoff)).alias("cutoff"))
    out = passed.unionByName(stats.filter("base_failed").withColumn("d2", F.lit(None).cast("double"))).crossJoin(F.broadcast(bound))  # one row
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(~F.col("base_failed") & (F.col("d2") <= F.col("cutoff")), F.lit(False)).alias("kept"), "d2")
